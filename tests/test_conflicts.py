import pytest

from provena.functions.text import base_value, float_text
from provena.operators import conflicts, graph, settle
from provena.schema import STOP_TAILS


def nodes(spark, *texts):
    """One statement per file, in order."""
    p = graph.parse(spark.createDataFrame([(0, f"f{i}.md", t) for i, t in enumerate(texts)], "src_ord int, rel_path string, text string"))
    return graph.nodes(p).filter("kind = 'statement'")


def none(spark):
    return spark.createDataFrame([], "name string, signature string")


def found(rows):
    return sorted((r.name, r.number, r.unit) for r in rows.collect())


def test_named(spark):
    got = conflicts.named(nodes(spark, "tray depth: 3500 mm and gap = 2.5 s", "status: 5 m", "x: 5 meters", "깊이 값: 3 km, load = -4 KB"))
    assert found(got) == [("and gap", 2.5, "s"), ("load", -4.0, "KB"), ("tray depth", 3.5, "m"), ("깊이 값", 3000.0, "m")]


def test_watched(spark):
    n = nodes(spark, "Tray Width is fixed at 600 mm", "tray width + 0.30 m", "tray width is over 3 m", "tray width" + " " * 18 + "3 m", "the clearance 1 m, edge clearance 2 m")
    assert found(conflicts.watched(n)) == [("clearance", 1.0, "m"), ("clearance", 2.0, "m"), ("edge clearance", 2.0, "m"), ("tray width", 0.6, "m")]
    assert found(conflicts.watched(n, ("tray width",))) == [("tray width", 0.6, "m")]
    assert conflicts.watched(n, ()).count() == 0
    with pytest.raises(ValueError):
        conflicts.watched(n, ("a", ""))


def test_context(spark):
    n = nodes(spark, "the upper shelf holds 40 KB while the lower shelf holds 1,250.5 MB", "it is 5 m", "a b 5 m", "2024-05-06 5 m", "측정 결과값 7 %")
    assert found(conflicts.context(n)) == [("lower shelf holds", 1250.5, "MB"), ("upper shelf holds", 40.0, "KB"), ("측정 결과값", 7.0, "%")]
    assert all(conflicts.context(nodes(spark, f"some value {w} 5 m")).count() == 0 for w in STOP_TAILS[:3])


def test_conflicts_and_suppression(spark):
    n = nodes(spark, "rack height: 3.5 m", "rack height: 3500 mm", "rack height: 4 m", "pole: 1 m and pole: 2 m", "load: 5 s", "load: 5 m")
    strong = conflicts.strong_observations(n)
    got = conflicts.conflicts(strong, none(spark)).collect()
    assert [(r.name, r.n_values, r.signature, r.suppressed) for r in got] == [("rack height", 2, "3.5m|4.0m", False)]
    held = spark.createDataFrame([("rack height", "3.5m|4.0m")], "name string, signature string")
    assert conflicts.conflicts(strong, held).first().suppressed
    assert not conflicts.conflicts(strong, held.withColumn("signature", held.signature.substr(1, 4))).first().suppressed
    c = conflicts.counts(strong, conflicts.context_observations(n, strong), held).first()
    assert (c.names, c.suppressed) == (4, 1)
    v = {(r.number): r.sources for r in conflicts.values(strong).filter("name = 'rack height'").collect()}
    assert v == {3.5: ["f0.md:1", "f1.md:1"], 4.0: ["f2.md:1"]}


def test_rounding_is_pythons(spark):
    rows = [("0.0045", "m"), ("1.0005", "m"), ("0.5", "mm"), ("2.5", "mm"), ("1,234.5", "km"), ("12", "%")]
    got = spark.createDataFrame(rows, "n string, u string").select(base_value("n", "u").alias("v")).select("v", float_text("v").alias("t")).collect()
    want = [round(float(n.replace(",", "")) * {"mm": 0.001, "km": 1000.0}.get(u, 1.0), 3) for n, u in rows]
    assert [r.v for r in got] == want and [r.t for r in got] == [str(w) for w in want]


def test_values_are_bounded(spark):
    n = nodes(spark, *["rack height: 3.5 m"] * 6)
    strong = conflicts.strong_observations(n)
    few, every = (conflicts.values(strong, k).first() for k in (2, None))
    assert (few.n_sources, few.sources) == (6, ["f0.md:1", "f1.md:1"]) and every.sources == [f"f{i}.md:1" for i in range(6)]


def test_picks_and_spellings():
    assert settle.parse_picks("1:2, 2:3 x 4:y") == ([settle.Pick(1, 2), settle.Pick(2, 3)], ["x", "4:y"])
    assert settle.spellings(0.6, "m") == ["0.6 m", "0.6m", "600 mm", "600mm", "60 cm", "60cm"]
    assert settle.spellings(0.0045, "m") == ["0.0045 m", "0.0045m"] and settle.spellings(0.045, "m")[2:] == ["45 mm", "45mm"]
    assert settle.spellings(5.0, "%") == ["5 %", "5%"]


def test_plan_takes_the_best_lines(spark):
    wanted = spark.createDataFrame([(1, "tray width", 0.6, "m", settle.pattern(0.6, "m"), f, n, "1 m") for f, n in (("a", 2), ("b", 1), ("c", 1), ("d", 1))], "index int, name string, number double, unit string, rx string, file string, line int, new_text string")
    lines = [("a", 1, "tray width 600 mm"), ("a", 2, "it is 0.6 m"), ("b", 1, "none"), ("b", 2, "1600 mm"), ("b", 3, "Tray of width 60cm"), ("b", 4, "0.6 m"), ("c", 1, "6 m"), ("c", 2, "0.6m"), ("c", 3, "x 600mm y"), ("d", 1, "0.65 m")]
    found = settle.plan(wanted, spark.createDataFrame(lines, "file string, line int, raw string"))
    assert sorted((r.file, r.line, r.at_source) for r in found.collect()) == [("a", 2, True), ("b", 3, False), ("c", 2, False), ("c", 3, False)]


def test_settle_rewrites_only_when_told(spark, tmp_path):
    one, two = tmp_path / "one.md", tmp_path / "two.md"
    one.write_bytes(b"intro\r\nrack height: 3.5 m, not 13.5 m\r\n")
    two.write_text("rack height: 4 m\n")
    n = spark.createDataFrame([("a", "rack height: 3.5 m", "statement", str(one), 1), ("b", "rack height: 4 m", "statement", str(two), 1)], "id string, label string, kind string, source_file string, source_location int")
    from pyspark.sql import functions as F

    n = n.withColumn("ins", F.struct(F.lit(1).alias("phase")))
    strong = conflicts.strong_observations(n)
    paged = settle.page(conflicts.conflicts(strong, none(spark)), conflicts.conflicts(conflicts.context_observations(n, strong), none(spark)))
    marks = {r["index"]: (r["name"], r["signature"]) for r in paged.collect()}
    numbered = settle.choices(paged, conflicts.values(strong))
    lines = spark.createDataFrame([(str(p), i, x) for p in (one, two) for i, x in enumerate(p.read_text().split("\n"), 1)], "file string, line int, raw string")
    dry = settle.settle(numbered, marks, "1:2 7:1 1:5 x", lines)
    assert (dry.fixed, dry.skipped) == (1, 3) and f"{one}:2: 3.5 m -> 4 m" in dry.messages and "3.5 m" in one.read_text()
    log = []
    done = settle.settle(numbered, marks, "1:2", lines, log=lambda *x: log.append(x), confirm=True)
    assert done.fixed == 1 and one.read_bytes() == b"intro\r\nrack height: 4 m, not 13.5 m\r\n" and log == [("edited", "rack height", f"{one}:2", "3.5 m -> 4 m")]
    again = settle.settle(numbered, marks, "1:2", lines, confirm=True)
    assert (again.fixed, again.skipped) == (0, 1) and "no such value" in again.messages[0]
    held = {}
    assert settle.settle(numbered, marks, "1:3", lines, suppress=held.__setitem__, confirm=True).suppressed == 1 and held == {"rack height": "3.5m|4.0m"}
    assert settle.settle(numbered, marks, "1:4", lines).left == 1
    gone = settle.settle(numbered, marks, "1:1", lines.filter(lines.file == str(one)))
    assert gone.skipped == 1 and gone.messages == [f"{two}: 4 m is not in it"]
    two.unlink()
    assert settle.settle(numbered, marks, "1:1", lines).skipped == 1


def test_page_as_text(spark):
    rows = [(1, "rack height", 1, 3.5, "m", 3, ["a.md:1", "b.md:2"]), (1, "rack height", 2, 4.0, "m", 1, ["c.md:1"]), (2, "load", 1, 0.25, "s", 2, ["a.md:3", "b.md:3"])]
    numbered = spark.createDataFrame(rows, "index int, name string, choice int, number double, unit string, n_sources long, sources array<string>")
    assert settle.render(numbered, 12).split("\n") == [
        "open conflicts: 12, of which the first 10",
        "[1] rack height",
        "    1:1  3.5 m  in a.md:1 b.md:2 (+1)",
        "    1:2  4 m  in c.md:1",
        "    1:3  they may differ    1:4  later",
        "[2] load",
        "    2:1  0.25 s  in a.md:3 b.md:3",
        "    2:2  they may differ    2:3  later",
    ]
    assert settle.render(numbered.filter("false"), 0) == "open conflicts: 0"
