import json
import math
import random

import pytest
from pyspark.sql import functions as F

from provena.operators import chain, components, conflicts, graph, markdown, outline, score, search
from provena.operators.graph import document_order
from provena.plans import corpus, queries
from provena.schema import CAUSE_RELATIONS, NEARBY_RELATIONS

SMALL = "/root/testdata/sf0.001"


def notes(spark, *rows):
    return spark.createDataFrame([(0, p, t) for p, t in rows], "src_ord int, rel_path string, text string")


def built(spark, *rows):
    p = graph.parse(notes(spark, *rows))
    return graph.nodes(p), graph.links(p)


def test_nodes_links_and_names(spark):
    nodes, links = built(spark, ("a.md", "# Top\nsee [[B: x]] and [[Missing  One]]\n- caused_by [[b- x]]"), ("b- x.md", "text [[missing one]]"))
    got = {(r.id, r.label, r.kind, r.source_file, r.source_location) for r in nodes.collect()}
    assert ("doc_a", "a", "document", "a.md", 1) in got and ("doc_a_s0", "Top", "section", "a.md", 1) in got
    assert ("name_missing_one", "Missing  One", "name_only", "", None) in got
    edges = sorted((r.source, r.target, r.relation) for r in links.collect())
    assert ("doc_a", "doc_b-_x", "caused_by") in edges and ("doc_a", "doc_b-_x", "mentions") not in edges
    assert ("doc_b-_x", "name_missing_one", "mentions") in edges


def test_last_document_wins_a_key_and_rows_stay(spark):
    nodes, links = built(spark, ("x/n.md", "one"), ("y/n.md", "two\n[[n]]"))
    assert nodes.filter("id = 'doc_n'").count() == 2 and nodes.filter("id = 'doc_n_t0'").count() == 2
    known = {r.id: r.source_file for r in graph.last_by_id(nodes).collect()}
    assert known["doc_n"] == "y/n.md"
    assert links.filter("source = 'doc_n' and target = 'doc_n' and relation = 'mentions'").count() == 1


def test_two_keys_can_share_a_name_id(spark):
    nodes, _ = built(spark, ("a.md", "[[q r]] [[q_r]]"))
    assert sorted(r.label for r in nodes.filter("id = 'name_q_r'").collect()) == ["q r", "q_r"]


def test_documents_come_before_sub_folders(spark):
    paths = ["b.md", "a/z.md", "a/b/c.md", "a.md", "B.md", "a/a.md"]
    got = notes(spark, *((p, "") for p in paths)).orderBy(document_order(F.col("rel_path"))).collect()
    assert [r.rel_path for r in got] == ["B.md", "a.md", "b.md", "a/a.md", "a/z.md", "a/b/c.md"]


def test_same_input_same_rows(spark):
    rows = [("a.md", "# A\none [[b]] [[c]]\n- follows [[b]]"), ("b.md", "2 m"), ("p.html", "<h1>T</h1><p>x</p><a href='b'>b</a>")]
    first, second = ([json.dumps([r.asDict() for r in f(t).collect()]) for f, t in zip((graph.ordered_nodes, graph.ordered_links), built(spark, *rows))] for _ in range(2))
    assert first == second


def plain_walk(start, links, forward, relations, depth):
    seen, queue, out = {start}, [start], []
    for level in range(1, depth + 1):
        later = []
        for node in queue:
            for s, t, r in links:
                head, tail = (s, t) if forward else (t, s)
                if r in relations and head == node and tail not in seen:
                    seen.add(tail)
                    later.append(tail)
                    out.append((tail, r, level))
        queue = later
    return out


@pytest.mark.parametrize("forward", [True, False])
def test_walk_is_breadth_first(spark, forward):
    rng = random.Random(5)
    links = sorted((f"n{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.choice(["caused_by", "led_to", "x"])) for _ in range(70))
    df = spark.createDataFrame(links, "source string, target string, relation string")
    starts = spark.createDataFrame([(f"n{i}",) for i in range(25)], "start string")
    got = chain.walk(starts, df, forward, ("caused_by", "led_to"), 3).orderBy("start", "level", "rank").collect()
    for i in range(25):
        mine = [(r.id, r.relation, r.level) for r in got if r.start == f"n{i}"]
        assert mine == plain_walk(f"n{i}", links, forward, ("caused_by", "led_to"), 3)


def test_find_node_and_show(spark):
    nodes, links = built(spark, ("ADR 1.md", "# ADR 1 plan\n- caused_by [[ADR 2]]"), ("ADR 2.md", "- caused_by [[ADR 3]]"), ("ADR 3.md", "x"))
    assert chain.find_node(nodes, " adr 1 ").first().id == "doc_adr_1"
    assert chain.find_node(nodes, "plan").first().id == "doc_adr_1_s0"
    assert chain.find_node(nodes, "none").count() == 0
    text = chain.show(nodes, links, "ADR 1")
    assert "caused_by ADR 2  [ADR 2.md:1]" in text and "ADR 3" in text and chain.show(nodes, links, "zz").startswith("No node")


def test_components_and_scores(spark):
    rng = random.Random(2)
    edges = [(f"v{a:03}", f"v{b:03}") for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(80))] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    ids = sorted({x for e in edges for x in e} | {f"v{i:03}" for i in range(120)})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges, "a string, b string"))
    assert {r.id: r.component for r in got.collect()} == {i: find(i) for i in ids}

    nodes, links = built(spark, ("a.md", "[[a]]"), ("b.md", "has 5 of it"), ("c.md", ""))
    line = score.line(score.metrics(nodes, links).first().asDict(), 1, 2)
    assert line == "5 nodes, 3 links of 2 kinds, 100.0% with a place, 3 components, 1 of 2 samples found on their lines"
    row = score.metrics(nodes, links).first()
    assert (row.components, row.isolated) == (3, 1) and row.located_ratio == 1.0
    assert score.hints(score.metrics(nodes, links)).first().hints
    assert [r.id for r in score.samples(nodes).collect()] == ["doc_b_t0"]
    empty = score.metrics(nodes.filter("false"), links.filter("false")).first()
    assert (empty.nodes, empty.located_ratio, empty.components, empty.isolated) == (0, 0.0, 0, 0)
    lines = spark.createDataFrame([("b.md", 1, "it has 5 of it"), ("a.md", 1, "other")], "source_file string, source_location int, raw string")
    assert {r.id: r.verified for r in score.verify(nodes.filter("kind = 'statement'"), lines).collect()} == {"doc_a_t0": False, "doc_b_t0": True}


def test_components_take_few_rounds(spark):
    """A chain whose ids rise and whose end is the least: labels that only spread need a round for each link."""
    for chain_ids in ([*range(2, 201), 1], [x for i in range(1, 101) for x in (i, 201 - i)]):
        writes = []

        def keep(df, label, writes=writes):
            writes.append(label)
            return components.written(df, label)

        edges = spark.createDataFrame(list(zip(chain_ids[:-1], chain_ids[1:])), "a int, b int")
        got = components.labels(edges, keep)
        assert {r.label for r in got.collect()} == {1} and got.count() == 200
        assert writes.count("labels") <= 2 * math.log2(200) + 5


def test_chain_shows_twenty_rows(spark):
    nodes, links = built(spark, ("hub.md", "\n".join(f"- caused_by [[N {i}]]" for i in range(23))))
    text = chain.show(nodes, links, "hub").split("\n")
    assert text[1:3] == ["came from:", "  caused_by N 0  [?:?]"] and text[22] == "  and 3 more" and text[23] == "led to:"


def test_search(spark):
    nodes, links = built(spark, ("Tray.md", "# Tray width\nTray width is 600 mm\n- follows [[Rack]]"), ("Rack.md", "rack of iron"), ("Other.md", "[[Rack]]"))
    got = search.seeds(nodes, "what is the tray width?").collect()
    assert [r.id for r in got] == ["doc_tray_t0", "doc_tray_s0", "doc_tray"]
    assert search.seeds(nodes, "ширина").count() == 0
    full = search.answer(nodes, links, "tray width").orderBy("place").collect()
    assert full[0].label == "Tray width" and not full[0].truncated and len({r.id for r in full}) == len(full)
    cut = search.answer(nodes, links, "tray width", 30).collect()
    assert sum(len(r.label) for r in cut) <= 30 and all(r.truncated for r in cut)
    path = search.shortest_path(nodes, links, "tray", "OTHER").orderBy("hop").collect()
    assert [(r.source, r.relation, r.target) for r in path] == [("doc_tray", "follows", "doc_rack"), ("doc_other", "mentions", "doc_rack")]
    assert search.shortest_path(nodes, links, "tray", "none").count() == 0
    assert {(r.source, r.direction) for r in search.explain(nodes, links, "Rack").collect()} == {("doc_rack_t0", "in"), ("doc_tray", "in"), ("doc_other", "in")}
    assert "NODE Tray width is 600 mm" in search.render(search.answer(nodes, links, "tray width"))


MATCHED = [
    (0, "a.md", "# 5 m\nthe width is 3 MB\nnothing\n[[Depth 7  KB]] [[none]] [[5 mm]]"),
    (0, "5 mm.md", "no value\n- 9 kMs"),
    (1, "b.html", "<h1>6&#32;%</h1><p>7 <b>mm</b></p><p>8 dm</p>"),
    (1, "c.md", "[[depth 7 kb]] and 12 GB"),
    (2, "d.md", ""),
    (2, "e.md", None),
]


def test_matching_nodes_are_those_of_the_map(spark):
    notes = spark.createDataFrame(MATCHED, "src_ord int, rel_path string, text string")
    pattern = conflicts.HOLDS_VALUE
    want = graph.nodes(graph.parse(notes)).filter(F.col("label").rlike(pattern))
    got = graph.matching(notes, pattern)
    key = lambda r: repr(r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert {r.label for r in got.collect()} == {"5 m", "the width is 3 MB", "[[Depth 7  KB]] [[none]] [[5 mm]]", "Depth 7  KB", "5 mm", "6 %", "7 mm", "9 kMs", "[[depth 7 kb]] and 12 GB"}


def test_mentions_from_a_note_named_as_a_piece(spark):
    rows = [(0, "a.md", "# T\nx\n[[a s0]]"), (0, "a s0.md", "[[a]] [[b]]"), (0, "a s5.md", "[[a]]"), (0, "b.md", "[[a]]\n- covers [[a]]")]
    pieces = graph.parse(spark.createDataFrame(rows, "src_ord int, rel_path string, text string"))
    got = sorted(graph.links(pieces).collect())
    assert got == sorted(graph.suppress_mentions(graph.all_links(pieces)).collect())
    assert ("doc_a_s0", "doc_a", "mentions") not in got and ("doc_a_s0", "doc_b", "mentions") in got and ("doc_a_s5", "doc_a", "mentions") in got


def test_a_path_and_its_links_take_no_distinct_of_all_links(spark):
    links = spark.createDataFrame([("a", "b", "r"), ("a", "b", "r"), ("b", "c", "r")], "source string, target string, relation string")
    assert "Exchange" not in search.undirected(links)._jdf.queryExecution().executedPlan().toString()


OUTLINED = [
    (0, "a.md", "# T\nx\n[[a s0]] [[q r]] [[q_r]]\n- covers [[lost one]]\nsee [[lost one]]"),
    (0, "a s0.md", "[[a]] [[b]]"),
    (0, "a s5.md", ""),
    (1, "u v.md", "one"),
    (1, "u_v.md", "# two\n\nthree"),
    (1, "x/b.md", "[[a]]\n- covers [[a]]\n- part_of [[c]]"),
    (1, "y/b.md", "# U\n[[a]] [[Lost  One]] [[lost_one]]\n5 m"),
    (2, "c.md", "\n".join(f"[[n {i}]]" for i in range(9))),
    (2, "d.html", "<h1>T</h1><p>x</p><a href='n 3'>b</a><a href='e'>b</a>"),
    (2, "e t0.md", ""),
    (2, "e.md", "alone with its name"),
    (3, "me.md", None),
    (3, "only.md", "---\nx\n---\n"),
    (3, None, "text"),
]


@pytest.mark.parametrize("rows, run_keys", [(OUTLINED, 1), ([], 4)])
def test_outline_scores_as_the_whole_graph(spark, rows, run_keys):
    notes = spark.createDataFrame(rows, "src_ord int, rel_path string, text string").coalesce(2)
    pieces, o = graph.parse(notes), outline.of(notes, run_keys=run_keys)
    nodes, links = graph.nodes(pieces, components.written).cache(), graph.links(pieces)
    got, want = score.outline_metrics(o), score.metrics(nodes, links)
    assert got.dtypes == want.dtypes and got.collect() == want.collect()
    key = lambda r: repr(r)
    labels = score.component_labels(nodes, links).groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    assert sorted(score.outline_components(o).collect(), key=key) == sorted(labels.collect(), key=key)
    assert sorted(score.outline_isolated(o).collect(), key=key) == sorted(score.isolated(nodes, links).collect(), key=key)


def test_links_of_scattered_documents_meet_in_a_run(spark):
    rows = [(0, f"n {i:03}.md", f"[[n {i - 1:03}]]" if i % 20 else "") for i in range(400)]
    random.Random(3).shuffle(rows)
    kept = {}

    def keep(df, label):
        kept[label] = components.written(df, label)
        return kept[label]

    o = outline.of(spark.createDataFrame(rows, "src_ord int, rel_path string, text string").repartition(4), keep, run_keys=50)
    assert kept["points"].filter(F.size("at") > 1).count() <= 20
    assert sorted(score.outline_components(o).collect()) == [(f"doc_n_{i:03}", 39) for i in range(0, 400, 20)]
    row = score.hints(score.outline_metrics(o)).first()
    assert row.components == 20 and "many separate components" in row.hints


def shuffled(spark, make):
    """Rows that the stages of make() put through exchanges."""
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    rows = lambda: {s.apply(i).stageId(): s.apply(i).shuffleWriteRecords() for s in [store()] for i in range(s.size())}
    before = set(rows())
    make()
    return sum(n for stage, n in rows().items() if stage not in before)


@pytest.mark.parametrize("name", ["score_metrics", "connected_components", "score_hints", "isolated_nodes"])
def test_scores_shuffle_documents_not_their_pieces(spark, monkeypatch, name):
    documents = sum(spark.read.parquet(f"{SMALL}/{table}.parquet").count() for table in corpus.TABLES)
    monkeypatch.setattr(queries, "_maps", {})
    assert shuffled(spark, lambda: queries.QUERIES[name](spark, SMALL).collect()) < 8 * documents


def test_mentions_are_dropped_in_their_rows(spark):
    """Neither links nor keys of documents go through an exchange to count mentions, but those of
    documents that share their id or write a key in two ways."""
    rows = [(0, f"n {i:03}.md", f"[[n {i - 1:03}]] [[N {i - 1:03}]] [[lost {i}]]\n- covers [[lost {i - i % 2}]]") for i in range(300)]
    for more, most in (([], 20), (OUTLINED, 150)):
        notes = spark.createDataFrame(rows + more, "src_ord int, rel_path string, text string").coalesce(2)
        pieces, o = graph.parse(notes), outline.of(notes)
        o.points.count()
        got = []
        assert shuffled(spark, lambda: got.extend(outline.kept_mentions(o).collect())) < most
        assert got[0].mentions == graph.suppress_mentions(graph.all_links(pieces)).filter("relation = 'mentions'").count()


def test_mentions_of_any_links_are_counted_as_in_the_whole_graph(spark):
    rng = random.Random(5)
    names = ["a", "a s0", "a_s0", "a t1", "b c", "b_c", "d", "lost e", "lost_e", "lost f", "part"]
    for _ in range(3):
        rows = []
        for name in names[:7] + rng.choices(names[:7], k=4):
            links = [f"- {rng.choice(['covers', 'part_of', 'mentions'])} [[{rng.choice(names)}]]" if rng.random() < 0.4 else f"see [[{rng.choice(names)}]]" for _ in range(8)]
            rows.append((0, f"{rng.randrange(99)}/{name}.md", "\n".join(["# T", *links])))
        notes = spark.createDataFrame(rows, "src_ord int, rel_path string, text string").coalesce(2)
        want = graph.suppress_mentions(graph.all_links(graph.parse(notes))).filter("relation = 'mentions'").count()
        assert outline.kept_mentions(outline.of(notes)).first().mentions == want > 0


def test_documents_are_not_shuffled_to_find_pieces_among_them(spark):
    notes = spark.range(20000).selectExpr("0 as src_ord", "concat('n ', id, '.md') as rel_path", "concat('[[n ', id - id % 20, ']]') as text")
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "5000")
    try:
        assert 40_000 <= shuffled(spark, lambda: outline.of(notes)) < 50_000
    finally:
        spark.conf.unset(key)


VERIFIED = [(0, "f.md", "---\nx: 1\n---\n- one\n# T\n  two 2"), (0, "g.html", "---\n<p>in front</p>\n---\n<p>on <b>one</b> line</p>\n<p>plain</p>"), (0, "h.md", "\u3000wide\u3000"), (0, "i.md", None)]
TWICE = [(1, "w/n.md", "same\nhere"), (1, "w/n.md", "same\nthere"), (1, "w/n.md", "")]


@pytest.mark.parametrize("rows, joins", [(OUTLINED + VERIFIED, False), (OUTLINED + VERIFIED + TWICE, True)])
def test_notes_are_verified_in_their_rows(spark, rows, joins):
    notes = spark.createDataFrame(rows, "src_ord int, rel_path string, text string")
    lines = markdown.with_lines(notes.select(F.col("rel_path").alias("source_file"), "text")).select("source_file", F.explode("ls").alias("s")).select("source_file", F.col("s.line").alias("source_location"), "s.raw")
    want = score.verify(graph.nodes(graph.parse(notes)).filter("kind = 'statement'"), lines).drop("label")
    got = score.verify_notes(notes)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert {r.verified for r in got.collect()} == {True, False}
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == joins


def test_verify_samples_shuffles_paths_alone(spark, monkeypatch):
    documents = sum(spark.read.parquet(f"{SMALL}/{table}.parquet").count() for table in corpus.TABLES)
    monkeypatch.setattr(queries, "_maps", {})
    assert shuffled(spark, lambda: queries.QUERIES["verify_samples"](spark, SMALL).collect()) <= 2 * documents


WALKED = [
    (0, "a.md", "# T\nx\n- caused_by [[a s0]]\n- led_to [[Lost  One]]\n- caused [[q_r]]\n* supersedes [[b|the b]]\nsee [[b]]\n- mentions [[b]]\n- 대체함 [[c]]"),
    (0, "a s0.md", "- caused_by [[a]]\n- caused_by [[b]]\n- causes [[b]]\n- extends [[a s0]]\n- extends [[e t0]]"),
    (0, "a s00.md", "---\nk: [[b]]\n- caused_by [[b]]\n --- \n- caused_by [[a s0]]\n　- led_to　[[ a T0 ]]　"),
    (1, "a t0.md", "\x0b---\t\r\n- caused_by [[b]]"),
    (1, "u v.md", "---\n---\n- follows [[u_v]]\n# - follows [[b]]\n- follows [[b]] and more"),
    (1, "u_v.md", "--- \n---x\n- follows [[b]]\n---\r\n- follows [[q r]]\r\n- follows [[b]]\n---\n- causes [[a]]"),
    (1, "x/b.md", "\n---\n- led_to [[c]]\n---\n- led_to [[lost_one]]\n- part_of [[c]]\n- led_to [[none.md]]\n- led_to []]"),
    (1, "y/b.md", "# U\n[[Lost  one]] [[lost_one]]\n- caused_by [[d]]\n- caused_by [[b]]\n- 2x [[b]]\n-caused_by [[b]]"),
    (2, "c.md", "- caused_by [[a/s0]]\n- caused_by [[A: S0]]\n- corrects [[lost one]]\n- 정정 [[u V]]"),
    (2, "d.html", "<h1>T</h1><p>- caused_by [[b]]</p><a href='lost one'>b</a><a href='e'>b</a>"),
    (2, "e.md", "x\n- caused_by [[b]]\n---"),
    (2, "e t0.md", "---"),
    (3, "me.md", None),
    (3, None, "- caused_by [[b]]"),
]


def test_chains_read_from_notes_are_those_of_the_map(spark):
    """Ids of names, of pieces and of several documents, front matter of every kind, and random links."""
    rng = random.Random(7)
    names = ["a", "a s0", "a_s0", "a t1", "b c", "b_c", "d", "lost e", "lost_e", "lost f"]
    drawn = []
    for name in names[:7] + rng.choices(names[:7], k=4):
        links = [f"- {rng.choice(['causes', 'led_to', 'follows', '후속', '참고'])} [[{rng.choice(names)}]]" for _ in range(3)]
        drawn.append((rng.randrange(2), f"{rng.randrange(99)}/{name}.md", "\n".join(["# T", *links])))
    for rows in (WALKED + drawn,):
        notes = spark.createDataFrame(rows, "src_ord int, rel_path string, text string").coalesce(2)
        pieces = graph.parse(notes)
        nodes, links = graph.nodes(pieces).cache(), graph.links(pieces).cache()
        relations = (*CAUSE_RELATIONS, *NEARBY_RELATIONS)
        ends = graph.relation_links(notes, relations)
        assert sorted(ends.collect()) == sorted(links.filter(F.col("relation").isin(*relations)).collect())
        steps = chain.steps(ends)
        found = queries._chains(steps)
        got = chain.described(found, graph.looked_up(notes, steps.select(F.col("next").alias("id"))))
        starts = nodes.filter("kind = 'document'").select(F.col("id").alias("start")).distinct()
        want = chain.decorated(chain.chains(starts, links), nodes).select(got.columns)
        assert sorted(got.collect()) == sorted(want.collect())
        assert bool(rows) == (got.filter("id like 'name_%' and label <> id").count() > 0) == (got.filter("id = 'doc_a_s0' and label = 'T'").count() > 0)


def test_chains_shuffle_neither_mentions_nor_pieces(spark, monkeypatch):
    """Of documents with 60 statements and mentions each, no more than their ids and relations go through an exchange."""
    text = "concat('- caused_by [[n ', id - 1, ']]', repeat(concat('\\nsee [[n ', id, ']]'), 60))"
    notes = spark.range(1, 301).selectExpr("0 as src_ord", "concat('n ', id, '.md') as rel_path", f"{text} as text")
    monkeypatch.setattr(queries, "_maps", {})
    monkeypatch.setattr(queries, "notes", lambda *_: notes)
    for name, rows in (("chain_decorated", 2 * (299 + 298 + 297) + 3), ("chain_led_to", 299 + 298 + 297)):
        got = []
        assert shuffled(spark, lambda query=queries.QUERIES[name]: got.extend(query(spark, SMALL).collect())) < 300 * 40
        assert len(got) == rows
