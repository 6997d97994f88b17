import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from provena.operators import markdown

NOTE = """---
title: Tray
---
# Tray

## Size
Tray width is 3.5 m here
- a listed item

## Relations
- caused_by [[ADR 7|why]]
see [[Other]] and [[A: b]]
- 3 [[Third]]
- two words [[Fourth]]
- 대체함 [[ADR 6]]
- 모르는말 [[ADR 5]]
"""


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_sections_have_their_lines(spark):
    got = markdown.sections(docs(spark, NOTE)).orderBy("idx").collect()
    assert [(r.idx, r.line, r.title) for r in got] == [(0, 4, "Tray"), (1, 6, "Size"), (2, 10, "Relations")]


def test_statements_keep_relation_lines_and_strip_items(spark):
    got = markdown.statements(docs(spark, NOTE)).orderBy("idx").collect()
    assert [(r.line, r.statement) for r in got][:3] == [(7, "Tray width is 3.5 m here"), (8, "a listed item"), (11, "caused_by [[ADR 7|why]]")]
    assert [r.idx for r in got] == list(range(len(got)))


def test_relations_and_mentions(spark):
    got = markdown.links(docs(spark, NOTE)).orderBy("idx").collect()
    assert [(r.line, r.target, r.relation) for r in got] == [(11, "ADR 7", "caused_by"), (12, "Other", None), (12, "A: b", None), (13, "Third", None), (14, "Fourth", None), (15, "ADR 6", "supersedes"), (16, "ADR 5", "모르는말")]


def test_attribution_and_bodies(spark):
    rows = markdown.attributed(docs(spark, "before\n# A\none\n## B\ntwo\n- three")).orderBy("line").collect()
    assert [(r.statement, r.section) for r in rows] == [("before", ""), ("one", "A"), ("two", "B"), ("three", "B")]
    rows = markdown.bodies(docs(spark, "before\n# A\none\n## B\ntwo\n- three\n# C")).orderBy("line").collect()
    assert [(r.title, r.body) for r in rows] == [("A", "one\n"), ("B", "two\nthree\n"), ("C", "")]


@pytest.mark.parametrize("text", ["", None, "---\nnever closed\n# no\n[[x]]"])
def test_empty_and_unclosed(spark, text):
    d = docs(spark, text)
    assert markdown.sections(d).count() == markdown.statements(d).count() == markdown.links(d).count() == 0


def test_long_lines_are_kept_whole(spark):
    long = "word " * 400
    assert markdown.statements(docs(spark, long)).first().statement == long.strip()


LINES = [
    ("# a", "a", None, []),
    ("###### deep \t", "deep", None, []),
    ("####### seven", None, "####### seven", []),
    ("#none", None, "#none", []),
    ("# ", None, "#", []),
    ("#\u3000wide\u3000", "wide", None, []),
    ("  # indented", None, "# indented", []),
    ("# [[x]] in a heading", "[[x]] in a heading", None, []),
    ("- item", None, "item", []),
    ("\t* item  ", None, "item", []),
    ("-none", None, "-none", []),
    ("- ", None, "-", []),
    ("-\x1cunit", None, "unit", []),
    ("- rel [[x]]", None, "rel [[x]]", [("x", "rel")]),
    ("* 대체함 [[ x y |shown]] ", None, "대체함 [[ x y |shown]]", [("x y", "supersedes")]),
    ("- rel_2 [[x]]", None, "rel_2 [[x]]", [("x", "rel_2")]),
    ("- 2rel [[x]]", None, "2rel [[x]]", [("x", None)]),
    ("- two words [[x]]", None, "two words [[x]]", [("x", None)]),
    ("rel [[x]]", None, "rel [[x]]", [("x", None)]),
    ("- rel [[x]] more", None, "rel [[x]] more", [("x", None)]),
    ("- rel [[x]][[y]]", None, "rel [[x]][[y]]", [("x", None), ("y", None)]),
    ("[[a|b|c]] [[]] [[|d]] [[e", None, "[[a|b|c]] [[]] [[|d]] [[e", [("a", None)]),
    ("[[a[b]]", None, "[[a[b]]", [("a[b", None)]),
    ("", None, None, []),
    (" \x0b\u00a0", None, None, []),
]


def test_lines_by_themselves(spark):
    d = docs(spark, *(f"first\n{line}" for line, *_ in LINES))
    heads = [(r.id, r.line, r.title) for r in markdown.sections(d).orderBy("id").collect()]
    assert heads == [(i, 2, head) for i, (_, head, _, _) in enumerate(LINES) if head]
    said = [(r.id, r.line, r.statement) for r in markdown.statements(d).orderBy("id", "idx").collect()]
    assert said == [x for i, (_, _, s, _) in enumerate(LINES) for x in ([(i, 1, "first")] + ([(i, 2, s)] if s else []))]
    found = [(r.id, r.line, r.target, r.relation) for r in markdown.links(d).orderBy("id", "idx").collect()]
    assert found == [(i, 2, *t) for i, (_, _, _, targets) in enumerate(LINES) for t in targets]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["---", "# a", "- b", "- rel [[x]]", "[[y]] c", " ", "d  "]), max_size=8), min_size=20, max_size=60))
def test_lines_are_read_one_by_one(spark, notes):
    """What a line gives does not depend on its neighbours, but for front matter."""
    title = {"# a": "a"}
    statement = {"---": "---", "- b": "b", "- rel [[x]]": "rel [[x]]", "[[y]] c": "[[y]] c", "d  ": "d"}
    target = {"- rel [[x]]": ("x", "rel"), "[[y]] c": ("y", None)}
    want = []
    for i, lines in enumerate(notes):
        skip = 0
        if lines[:1] == ["---"]:
            skip = lines.index("---", 1) + 1 if "---" in lines[1:] else len(lines)
        want.append([(i, n, x) for n, x in enumerate(lines, 1) if n > skip])
    flat = [x for w in want for x in w]
    d = docs(spark, *("\n".join(lines) for lines in notes))
    assert [(r.id, r.line, r.title) for r in markdown.sections(d).orderBy("id", "line").collect()] == [(i, n, title[x]) for i, n, x in flat if x in title]
    assert [(r.id, r.line, r.statement) for r in markdown.statements(d).orderBy("id", "line").collect()] == [(i, n, statement[x]) for i, n, x in flat if x in statement]
    assert [(r.id, r.line, r.target, r.relation) for r in markdown.links(d).orderBy("id", "line").collect()] == [(i, n, *target[x]) for i, n, x in flat if x in target]
