import json

from provena import cli
from provena.sources.config import Config


def test_commands(spark, tmp_path, capsys):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "ADR 1.md").write_text("# Rack\nrack height: 3.5 m\n- caused_by [[ADR 2]]\n")
    (notes / "ADR 2.md").write_text("rack height: 4 m\n")
    path = str(tmp_path / "config.json")
    run = lambda *a: (cli.main(["--config", path, *a]), capsys.readouterr().out)[1]
    assert "Nothing configured" in run("score")
    Config(source_dirs=(str(notes),), map_path=str(tmp_path / "map")).write(path)
    assert "6 nodes" in run("build") and "unchanged" in run("build", "--quiet")
    assert len(json.loads((tmp_path / "map").read_text())["nodes"]) == 6
    assert "3 of 3 samples" in run("score")
    assert "NODE rack height: 3.5 m" in run("ask", "rack", "height")
    assert "1 hop(s)\n  doc_adr_1 --caused_by--> doc_adr_2" in run("path", "ADR 1", "ADR 2")
    assert "doc_adr_1 --caused_by--> doc_adr_2" in run("explain", "ADR 2")
    assert "caused_by ADR 2" in run("chain", "ADR 1")
    shown = run("conflicts")
    assert "[1] rack height\n    1:1  3.5 m  in ADR 1.md:2\n    1:2  4 m  in ADR 2.md:1\n" in shown
    assert "edits 1, dismissed 0, open 0, nothing done 0 - nothing was written" in run("settle", "1:2") and "3.5 m" in (notes / "ADR 1.md").read_text()
    assert "edits 1" in run("settle", "1:2", "--confirm") and "rack height: 4 m" in (notes / "ADR 1.md").read_text()
    assert "Changed since" in run("explain", "ADR 1")
