import hashlib
from collections import Counter

import numpy as np
import pytest
from tests_llm_cases import frame, hard_rows, words

from provena.llm import near_dedup, phrase_dedup, suffix_dedup
from provena.llm.suffix_dedup import boundaries, suffix_array


def sha(b):
    return hashlib.sha256(b).hexdigest()


def suffix_brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), sha(kept)))
    return Counter(out)


@pytest.mark.parametrize("length,gram,most", [(400, 48, 1 << 20), (40, 8, 1 << 20), (40, 8, 0), (40, 8, 300), (7, 3, 100)])
def test_suffix_dedup(spark, length, gram, most):
    rows = hard_rows()
    got = suffix_dedup.dedup(frame(spark, rows), length, gram, most).drop("spans").collect()
    assert Counter(map(tuple, got)) == suffix_brute(rows, length)


def long_rows():
    """Texts of several slices that share passages across the slices' borders, and repeat themselves."""
    import random

    from provena.llm.repeats import SLICE

    rng = random.Random(6)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shared, mine = say(400), say(60)
    text = say(90_000)
    at = SLICE - 1000
    rows = [(1, text[:at] + shared + text[at:]), (2, say(30) + " " + shared + " " + say(5)), (3, mine + " " + say(SLICE + 50) + " " + mine)]
    words = text.split()
    rows.append((4, " ".join(words + words[: SLICE - 9 - len(words) % SLICE] + shared.split() + words[-3000:])))
    return rows


def test_long_texts(spark):
    rows = long_rows()[:2]
    got = suffix_dedup.dedup(frame(spark, rows)).drop("spans").collect()
    assert Counter(map(tuple, got)) == suffix_brute(rows, 400)
    rows = long_rows()
    got = phrase_dedup.dedup(frame(spark, rows)).drop("spans").collect()
    assert Counter(map(tuple, got)) == phrase_brute(rows, 20)


def test_suffix_texts_take_clashing_names(spark):
    rows = [(1, "a" + "x" * 50), (2, "b" + "x" * 50)]
    df = spark.createDataFrame([(i, t, 7, 8, "k") for i, t in rows], "doc_id long, text string, kept int, `key` int, row string")
    got = suffix_dedup.dedup_texts(df, 50, 8)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a", 7, 8, "k"), (2, "b", 7, 8, "k")]


def test_distinct_texts_leave_no_table_name(spark):
    texts = near_dedup.distinct_texts(frame(spark, [(1, "x"), (2, "x"), (3, "y")]))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("provena")]
    assert sorted((r.text, r.copies, r.first_id) for r in texts.collect()) == [("x", 2, 1), ("y", 1, 3)]
    plan = texts.groupBy("k1", "k2").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_suffix_texts_are_cut_on_characters(spark):
    rows = [(1, "aé" + "x" * 50), (2, "bè" + "x" * 50), (3, None), (4, "alone")]
    df = frame(spark, rows)
    got = {r.doc_id: r.text for r in suffix_dedup.dedup_texts(df, 51, 8).collect()}
    # é and è end in different bytes, so only the run of x of 50 is shared: nothing goes at 51
    assert got == dict(rows)
    got = suffix_dedup.dedup_texts(df, 50, 8)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "aé", 2: "bè", 3: None, 4: "alone"} and got.columns == df.columns


def test_boundaries_come_by_value():
    rng = np.random.default_rng(4)
    for _ in range(60):
        pieces = [bytes(rng.choice(list(b"ab\0\xff"), rng.integers(0, 25)).tolist()) for _ in range(rng.integers(1, 6))]
        stop = int(rng.integers(1, 8))
        marked = [x for i, p in enumerate(pieces) for x in [*(1000 + c for c in p), i]]
        symbols = np.array([0 if x < 1000 else x - 999 for x in marked], np.uint16)
        want = sorted(range(len(marked)), key=lambda i: marked[i:])
        order = suffix_array(symbols)
        assert order.tolist() == want
        depth = boundaries(symbols, order, stop)
        for r in range(1, len(want)):
            a, b = marked[want[r - 1] :], marked[want[r] :]
            shared = next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
            assert depth[r] == (shared if shared < stop else -1)


def phrase_brute(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        w = words(rows[i][1])
        for k in range(len(w) - window + 1):
            place = (rows[i][0] is None, rows[i][0] or 0, k)
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), place), place)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [0] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i is None, i or 0, k):
                gone[k : k + window] = [1] * window
        out.append((i, len(w), sum(gone), sha(" ".join(a for a, b in zip(w, gone) if not b).encode())))
    return Counter(out)


@pytest.mark.parametrize("window,gram,most", [(20, 4, 400_000), (5, 2, 400_000), (5, 2, 0), (5, 2, 40), (20, 4, 0)])
def test_phrase_dedup(spark, window, gram, most):
    rows = hard_rows()
    got = phrase_dedup.dedup(frame(spark, rows), window, gram, most).drop("spans").collect()
    assert Counter(map(tuple, got)) == phrase_brute(rows, window)


def test_phrases_come_from_the_automata():
    """A shard's rows are the automaton's: without the windows it is made of nothing is found."""
    import pyarrow as pa

    part = pa.table({"h": [1, 1], "g": [2, 3], "size": [3, 1], "first_id": [5, 4], "k1": [0, 0], "k2": [0, 0], "at": pa.array([7, 2], pa.int32()), "data": [b"a b c d", b"x b c d e"]})
    got = phrase_dedup._shard(3)(part).to_pylist()
    assert [(r["g"], r["off"], r["len"], r["not_first"]) for r in got] == [(2, 0, 1, False), (2, 1, 1, True)]
    words, starts = phrase_dedup.recurring([b"a b c d", b"x b c d e"], np.array([True, False]), 3)
    assert len(starts) == 2
    piece, off, number = phrase_dedup.occurrences(words, starts, 3)
    assert sorted(zip(piece.tolist(), off.tolist())) == [(0, 0), (0, 1), (1, 1)]
    assert not len(phrase_dedup.occurrences(words, starts[:0], 3)[0])


def near_brute(rows, percent=80, width=2):
    def shingles(t):
        w = words(t, fold=True)
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            both = len(s & u)
            if i is not None and j is not None and both and 100 * both >= percent * len(s | u):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i) if s else i, True) for i, s in sets)


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, width):
    rows = hard_rows()
    got = near_dedup.dedup(frame(spark, rows), width).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, True) for r in got) == near_brute(rows, width=width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_a_spread_group(spark):
    """Copies at all distances, so that many share buckets without a link."""
    import random

    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(5000)]
    base = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(160):
        text = [rng.choice(vocab) if rng.random() < i / 800 else w for w in base]
        rows.append((i, " ".join(text)))
    rows += [(500 + i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(30)]
    got = near_dedup.dedup(frame(spark, rows), width=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, True) for r in got) == near_brute(rows)


def test_half_alike_texts_are_not_compared(spark):
    """Thousands of texts that share two thirds of their words: they meet in buckets, but only
    the few that can link stay in play."""
    import random

    rng = random.Random(4)
    common = [f"c{k}" for k in range(60)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(18)])) for i in range(2000)]
    texts = near_dedup.distinct_texts(frame(spark, rows, extra=False))
    marks = near_dedup.signatures(texts, 2)
    buckets = marks.selectExpr("first_id", "explode(bands) as bucket").groupBy("bucket").count()
    assert buckets.filter("count > 1").agg({"count": "sum"}).first()[0] > 2000
    own = texts.selectExpr("0 as grp", "first_id as label", "first_id", "text")
    assert near_dedup.in_play(own, 2, 80).count() == 0
    again = own.union(own.filter("first_id < 3").selectExpr("0", "label + 5000", "first_id + 5000", "concat(text, ' more')"))
    assert sorted(r.first_id for r in near_dedup.in_play(again, 2, 80).collect()) == [0, 1, 2, 5000, 5001, 5002]
    apart = again.selectExpr("if(first_id >= 5000, 1, 0) as grp", "label", "first_id", "text")
    assert near_dedup.in_play(apart, 2, 80).count() == 0
    assert near_dedup.links(texts, marks, 2).count() == 0


def test_signature_estimates(spark):
    a, b = " ".join(f"a{k}" for k in range(201)), " ".join(f"a{k}" for k in range(20, 221))
    values, bounds = near_dedup.shingles([a, b], 2)
    keys = near_dedup.band_keys(values, bounds, 4000, 1)
    same, true = (keys[0] == keys[1]).mean(), 180 / 220
    assert abs(same - true) < 0.03


@pytest.mark.parametrize("run", [suffix_dedup.dedup, phrase_dedup.dedup, near_dedup.dedup])
def test_empty_table(spark, run):
    assert run(frame(spark, [(1, "x")]).filter("false")).count() == 0
