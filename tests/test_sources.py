import json
import os

from provena.operators import graph
from provena.sources import map_store
from provena.sources.config import ENVIRONMENT, Config
from provena.sources.notes import diagnosis, listed, read_notes
from provena.streaming import refresh


def tree(root, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_bytes(data if isinstance(data, bytes) else data.encode())


FILES = {"b.md": "﻿one\r\ntwo\rthree", "_x.md": "hidden?", ".dir/y.markdown": "dot", "a/z.html": "<p>x</p>", "a.md": b"bad \xff byte", "skip.txt": "no", "c.MD": "no"}


def test_notes_source(spark, tmp_path):
    tree(tmp_path, FILES)
    rows = read_notes(spark, [str(tmp_path), str(tmp_path / "missing")]).collect()
    got = {r.rel_path: r.text for r in rows}
    assert got == {"b.md": "one\ntwo\nthree", "_x.md": "hidden?", ".dir/y.markdown": "dot", "a/z.html": "<p>x</p>", "a.md": "bad � byte"}
    assert [r for _, r, _ in listed([str(tmp_path)])] == ["_x.md", "a.md", "b.md", ".dir/y.markdown", "a/z.html"]
    assert read_notes(spark, [str(tmp_path / "missing")]).count() == 0
    assert diagnosis([str(tmp_path / "missing")], 0).startswith("not found") and diagnosis([str(tmp_path)], 5) == ""


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "deep" / "c.json"
    assert Config.read(path) == Config()
    Config(source_dirs=("x",), answer_budget=5).write(path)
    assert Config.read(path) == Config(source_dirs=("x",), answer_budget=5)
    path.write_bytes(b'\xef\xbb\xbf{"map_path": "m\xff", "other": 1}')
    assert Config.read(path) == Config(map_path="m\ufffd")
    monkeypatch.setenv(ENVIRONMENT, str(path))
    assert Config.place() == path and Config.read().map_path == "m\ufffd"


def test_map_store_and_rebuild(spark, tmp_path):
    notes = tmp_path / "notes"
    tree(notes, {"one.md": "# One\nrack height: 3.5 m\n- follows [[two]]", "two.md": "rack height: 4 m"})
    before = {p: (notes / p).read_bytes() for p in os.listdir(notes)}
    path = str(tmp_path / "out" / "map.json")
    assert refresh.rebuild(spark, [str(notes)], path, as_json=True) and not refresh.rebuild(spark, [str(notes)], path)
    store = map_store.MapStore(path)
    nodes, links = store.read(spark)
    assert nodes.count() == 6 and links.filter("relation = 'follows'").count() == 1
    first = open(path, "rb").read()
    assert refresh.rebuild(spark, [str(notes)], path, force=True, as_json=True)
    assert open(path, "rb").read() == first and len(json.loads(first)["nodes"]) == 6
    nodes, links = store.read(spark)
    assert open(store.report_path).read().split("\n") == [
        "Differing values: 1 of 1 names have several; 0 more names come from context; 0 dismissed.",
        "",
        "Name beside the value: 1",
        "- rack height = 3.5m|4.0m",
        "    3.5 m: one.md:2",
        "    4 m: two.md:1",
        "",
        "Name in the words before it: 0",
        "",
    ]
    store.suppress("rack height", "3.5m|4.0m")
    assert "; 1 dismissed." in store.report(nodes, ())
    open(store.suppressions_path, "w").write("{broken")
    assert store.suppressions(spark).count() == 0
    docs = read_notes(spark, [str(notes)])
    assert map_store.stale(docs, store.time()).count() == 0 and map_store.stale(docs, None).first().name == "(no map)"
    os.utime(notes / "two.md", (9e9, 9e9))
    assert [r.name for r in map_store.stale(read_notes(spark, [str(notes)]), store.time()).collect()] == ["two.md"]
    assert map_store.stale_notice(map_store.stale(read_notes(spark, [str(notes)]), store.time())).startswith("[Changed")
    assert refresh.rebuild(spark, [str(notes)], path)
    assert {p: (notes / p).read_bytes() for p in os.listdir(notes)} == before


def test_watch_sees_every_change(spark, tmp_path):
    notes, more = tmp_path / "notes", tmp_path / "more"
    tree(notes, {"one.md": "x", "two.md": "y"})
    tree(more, {"three.md": "z"})
    path = str(tmp_path / "map")
    store = map_store.MapStore(path)
    run = lambda: refresh.watch(spark, [str(notes), str(more)], path, str(tmp_path / "cp")).awaitTermination(120)
    labels = lambda kind: sorted(r.label for r in store.read(spark)[0].filter(f"kind = '{kind}'").collect())
    run()
    assert labels("document") == ["one", "three", "two"]
    first = store.version()
    run()
    assert store.version() == first
    (notes / "one.md").write_text("changed")
    os.utime(notes / "one.md", (2e9, 2e9))
    run()
    assert labels("statement") == ["changed", "y", "z"]
    tree(notes, {"_x.md": "hidden", ".dir/y.markdown": "dot"})
    run()
    assert labels("document") == ["_x", "one", "three", "two", "y"]
    (more / "three.md").unlink()
    more.rmdir()
    run()
    assert labels("document") == ["_x", "one", "two", "y"]


def test_watch_runs_on(spark, tmp_path):
    import time

    notes, path = tmp_path / "notes", str(tmp_path / "map")
    tree(notes, {"one.md": "x"})
    query = refresh.watch(spark, [str(notes)], path, str(tmp_path / "cp"), every="1 second")
    store = map_store.MapStore(path)
    for text in ("x", "later"):
        (notes / "one.md").write_text(text)
        for _ in range(60):
            time.sleep(1)
            if store.version() and store.read(spark)[0].filter(f"label = '{text}'").count():
                break
        else:
            raise AssertionError(text)
    query.stop()


def test_rebuild_and_watch_look_for_watched_names(spark, tmp_path, monkeypatch):
    notes = tmp_path / "notes"
    tree(notes, {"one.md": "bend radius is fixed at 200 mm", "two.md": "bend radius is fixed at 300 mm"})
    path = str(tmp_path / "map")
    refresh.rebuild(spark, [str(notes)], path)
    text = open(map_store.MapStore(path).report_path).read()
    assert "- bend radius = " in text[: text.index("Name in the words")]
    seen = []
    monkeypatch.setattr(refresh, "rebuild", lambda spark, folders, path, watched: seen.append(watched))
    refresh.watch(spark, [str(notes)], path, str(tmp_path / "cp-a")).awaitTermination(120)
    refresh.watch(spark, [str(notes)], path, str(tmp_path / "cp-b"), ("cap size",)).awaitTermination(120)
    assert seen == [refresh.WATCHED_NAMES, ("cap size",)]


def test_empty_folder(spark, tmp_path):
    p = graph.parse(read_notes(spark, [str(tmp_path)]).select("src_ord", "rel_path", "text"))
    assert graph.nodes(p).count() == 0 and graph.links(p).count() == 0
