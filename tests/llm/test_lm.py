import math
from collections import Counter, defaultdict

import pytest
from tests_llm_cases import frame, hard_rows, words

from provena.llm import lm_scoring


def brute(train, texts):
    """Score, base score and known tokens of each text by the formulas, with plain counts."""
    seq = lambda t: [*words(t, fold=True), None]
    uni, bi = Counter(), Counter()
    for t in train:
        x = seq(t)
        uni.update(x)
        bi.update(zip(["<s>", *x], x))
    n, v, pairs = sum(uni.values()), len(uni), len(bi)
    kinds, total, after = Counter(w for _, w in bi), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, _), c in bi.items():
        total[a] += c
        after[a][min(c, 3) - 1] += 1
    d, e = (lm_scoring.discounts([sum(c == i for c in x.values()) for i in (1, 2, 3, 4)]) for x in (bi, kinds))
    gamma = sum(e[min(c, 3)] for c in kinds.values()) / pairs if pairs else 1
    out = []
    for t in texts:
        x = seq(t)
        score = 0
        for a, w in zip(["<s>", *x], x):
            p = max(kinds[w] - e[min(kinds[w], 3)], 0) / max(pairs, 1) + gamma / (v + 1)
            if total[a]:
                p = max(bi[a, w] - d[min(bi[a, w], 3)], 0) / total[a] + sum(d[i + 1] * after[a][i] for i in range(3)) / total[a] * p
            score += math.log10(p)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        out.append((len(x), sum(uni[w] > 0 for w in x), n, base, score))
    return out


@pytest.mark.parametrize("shard_bytes", [8 << 20, 2000])
def test_scores_equal_plain_counts(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", shard_bytes)
    rows = hard_rows()
    model = lm_scoring.fit(frame(spark, rows[:-6]))
    got = sorted(lm_scoring.score(frame(spark, rows), model).collect(), key=lambda r: (str(r.doc_id), r.score))
    want = sorted(zip(rows, brute([t for _, t in rows[:-6]], [t for _, t in rows])), key=lambda x: (str(x[0][0]), x[1][4]))
    for r, (_, w) in zip(got, want):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


def test_probabilities_sum_to_one(spark):
    model = lm_scoring.fit(frame(spark, [(1, "a b a c"), (2, "b a"), (3, "a")]))
    for before in ("a", "b", "zz"):
        total = 0.0
        for after in ("a", "b", "c"):
            total += 10 ** (lm_scoring.score_texts(model, [f"{before} {after}"])[3][0] - lm_scoring.score_texts(model, [before])[3][0] + _end(model, before) - _end(model, after))
        total += 10 ** _end(model, before)
        unknown = lm_scoring.score_texts(model, [f"{before} qq"])[3][0] - lm_scoring.score_texts(model, [before])[3][0] + _end(model, before) - _end(model, "qq")
        assert total + 10**unknown == pytest.approx(1)


def _end(model, word):
    """log10 p(end | word), as the difference of two texts that share all else."""
    import numpy as np

    tokens, before, _ = lm_scoring.sequences([word])
    both = lm_scoring.score_texts(model, [word])[3][0]
    head = tokens[:1]
    p = _single(model, np.array([lm_scoring.BEGIN]), head)
    return both - math.log10(p)


def _single(model, before, word):
    w = lm_scoring._find(model, "words", lm_scoring._top(word, model.bits), word, [lm_scoring.U64, int, int])
    raw, kinds = int(w[0][0]), int(w[1][0])
    if word[0] in model.hot:
        kinds = int(model.hot_kinds[list(model.hot).index(word[0])])
    d, e = model.pair_discounts, model.word_discounts
    p = max(kinds - e[min(kinds, 3)], 0) / model.pairs + model.gamma / (model.types + 1)
    seen, *n = (int(x[0]) for x in lm_scoring._find(model, "contexts", lm_scoring._top(before, model.bits), before, [lm_scoring.U64, *[int] * 4]))
    c = int(lm_scoring._find(model, "bigrams", lm_scoring.shard_of(before, word, model.hot, model.bits), lm_scoring.bigram_key(before, word), [lm_scoring.U64, "u4"])[0][0])
    return (max(c - d[min(c, 3)], 0) + sum(a * b for a, b in zip(d[1:], n)) * p) / seen if seen else p


def test_nothing_to_learn_from(spark):
    df = frame(spark, [(1, "a b"), (2, None)])
    got = {r.doc_id: r for r in lm_scoring.score(df, lm_scoring.fit(df.filter("false"))).collect()}
    assert got[1].score == got[2].score == got[1].base_score == 0 and got[1].n_tokens == 3 and got[2].n_tokens == 1
