import importlib.util
import random
import re
import sys
from collections import Counter

import pytest
from test_dedup import near_brute
from tests_llm_cases import frame, hard_rows

import corpus_pipeline
from provena.llm.common import saved

TABLES = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark):
    docs = frame(spark, hard_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(spark, stage(spark, docs, TABLES), name)
        assert docs.columns == list(corpus_pipeline.DOCUMENT), name
        assert 0 < docs.count() <= before
        before = docs.count()
    texts = [r.text for r in docs.collect()]
    assert all(t is not None for t in texts) and sum(t.strip().lower() == "one" for t in texts) == 1


def test_leaks_are_dropped_row_by_row(spark):
    leak = spark.read.parquet(f"{TABLES}/benchmark.parquet").first().text
    texts = [" ".join(f"{w}{i}" for i in range(60)) for w in "ab"]

    def kept(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, TABLES).collect()), key=str)

    assert kept(corpus_pipeline.drop_leaks, [(None, leak), (None, texts[0]), (7, leak), (7, texts[1])]) == [(7, texts[1]), (None, texts[0])]


def test_near_duplicates_are_dropped_as_by_brute_force(spark):
    rows = [r for r in hard_rows() if r[0] not in (25, 26)]
    component = {i: c for i, _, c, _ in near_brute(rows, width=5)}
    longest = max((t for _, t in rows if t), key=len)
    rows += [(None, longest), (None, longest + " again")]  # copies of a document with an id
    alone = " ".join(f"own{i}" for i in range(90))
    rows += [(None, alone), (None, alone + " more")]  # of two without one, one stays
    docs = frame(spark, rows).select(*corpus_pipeline.DOCUMENT)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, TABLES).collect())
    assert sum(got.pop((None, t), 0) for t in (alone, alone + " more")) == 1
    want = Counter((i, t) for i, t in rows if (component[i] == i if i is not None else not (t or "").startswith((longest, alone))))
    assert got == want


def test_languages(spark):
    says = {"en": "the cat and the dog were in the house with the man".split(), "de": "der hund und die katze sind mit dem mann im haus".split(), "es": "el perro y los gatos estaban en la casa con un hombre".split()}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(says[lang]) for _ in range(40)), lang) for i, lang in enumerate(list(says) * 40)] + [(900, "12 34", "en"), (901, None, "en"), (902, "", None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.keep_language(spark, docs, TABLES).collect()} == {i for i, _, _ in rows[:-3]}


def cut_brute(texts):
    """Texts without the passages that the stage takes: repeated 200-byte strings, joined where
    they touch, of over 50 words or 400 bytes."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + 200] for b in raws for k in range(len(b) - 199))
    out = []
    for t, b in zip(texts, raws):
        kept, at, end = b"", 0, 0
        starts = [k for k in range(len(b) - 199) if seen[b[k : k + 200]] > 1] + [len(b) + 1]
        head = 0
        for i in range(1, len(starts)):
            if starts[i] > starts[i - 1] + 200:
                x, y = starts[head], starts[i - 1] + 200
                if y - x >= 400 or len(re.findall(rb"[^\x20\x09-\x0D]+", b[x:y])) > 50:
                    kept, at = kept + b[at:x], y
                head = i
        out.append(None if t is None else (kept + b[at:]).decode("utf-8", "ignore"))
    return out


def test_repeated_passages_are_cut(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long, short = say(52), say(40)
    texts = [f"{say(40)} {long} {say(20)}", f"{say(10)}\n{long}", f"{say(30)} {short} {say(9)}", f"{short} {say(40)}", f"{say(60)} {say(30)}", None, "", short, short, say(45)]
    rows = list(enumerate(texts)) + [(i, t) for i, t in hard_rows() if i not in (22,)]
    docs = frame(spark, rows).select(*corpus_pipeline.DOCUMENT)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, docs, TABLES).collect())
    want = Counter((i, t) for (i, _), t in zip(rows, cut_brute([t for _, t in rows])))
    assert got == want
    kept = [t or "" for t in (r[1] for r in got)]
    assert not any(long in t for t in kept) and sum(short in t for t in kept) >= 2


def test_no_passage_of_51_words_stays_shared(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    docs = saved(spark, corpus_pipeline.drop_near_duplicates(spark, docs, TABLES), "few")
    before = {r.doc_id: (r.text or "") for r in docs.collect()}
    after = {r.doc_id: (r.text or "") for r in corpus_pipeline.cut_repeats(spark, docs, TABLES).collect()}
    assert set(before) == set(after)

    def windows(t):
        w = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        return {t[w[k][0] : w[k + 50][1]] for k in range(len(w) - 50)}

    shared = Counter(x for t in before.values() for x in windows(t) if len(x.encode()) >= 200)
    shared = {x for x, n in shared.items() if n > 1}
    assert shared and not any(x in t for t in after.values() for x in shared)
    changed = [i for i in before if before[i] != after[i]]
    assert len(changed) < 0.2 * len(before)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_empty_tables(spark, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[k][1](spark, docs, TABLES).count() == 0


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, TABLES)
    total = spark.read.parquet(f"{TABLES}/documents.parquet").count()
    rows = got.collect()
    assert 0.5 * total < len(rows) < total and len({r.doc_id for r in rows}) == len(rows) and all(r.parity for r in rows)


def test_entry_stands_without_the_corpus_part(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("provena.llm", "corpus_pipeline") else real(name, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as e

    assert not any(q.startswith("op") or q == "pipeline" for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
