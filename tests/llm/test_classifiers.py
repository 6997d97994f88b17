import random
import re
import string

import numpy as np
import pytest
from tests_llm_cases import frame, hard_rows, words

from provena.llm import hashed, language_id, quality_rules, textkit, toxicity


def corpus(n=240, seed=1):
    """Two invented languages, with some toxic and some poor texts."""
    rng = random.Random(seed)
    langs = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(400)] for k, a in (("xx", "abcdefgh"), ("yy", "mnopqréè"), ("zz", "стуфхц"))}
    rows = []
    for i in range(n):
        lang = rng.choice(list(langs))
        text = [rng.choice(langs[lang]) for _ in range(rng.randint(60, 200))]
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        if poor:
            text = [w + "###" for w in text]
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["vilething", "badword!"]))
        rows.append((i, " ".join(text), lang, int(toxic), int(not poor)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, x) for i, _, _, x, q in rows], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 30])
def test_codewords(n):
    code = language_id.codewords(n)
    assert code.shape[0] == n
    assert n < 2 or all((code[i] != code[j]).sum() >= (1 if n == 2 else 2) for i in range(n) for j in range(i))


def test_language(spark):
    rows = corpus()
    docs, _ = tables(spark, rows)
    model = language_id.fit(docs.filter("doc_id < 120"), 40)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [r for r in rows if r[0] >= 120]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    hard = language_id.identify(frame(spark, hard_rows()), model).collect()
    assert len(hard) == len(hard_rows())
    by_text = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(1, None), (2, "12 !?"), (3, ""), (4, "abc")], "doc_id long, text string"), model).collect()}
    assert [by_text[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [by_text[i].score for i in (1, 2, 3)] == [0] * 3
    assert by_text[4].lang_pred in model.languages and all(0 <= r.score <= 1 for r in got.values())


def test_language_without_or_with_one_label(spark):
    docs, _ = tables(spark, corpus(20))
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.filter("false"))).collect()} == {"und"}
    got = language_id.identify(docs, language_id.fit(docs.filter("lang = 'xx'"))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("xx", 1.0)}


def plain_counts(text):
    w = words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hit = [0] * len(w)
    for k, x in enumerate(windows):
        if windows.count(x) > 1:
            hit[k : k + 3] = [1] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(hit)


def test_quality(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    model = quality_rules.fit(docs.filter("doc_id < 120"), labels)
    got = {r.doc_id: r for r in quality_rules.assess(docs, model).collect()}
    held = [r for r in rows if r[0] >= 120]
    assert np.mean([got[r[0]].kept == (r[4] == 1) for r in held]) > 0.95
    extra = [(i, t) for i, (_, t) in enumerate([r for r in hard_rows() if len(r[1] or "") < 3000])] + [(90, "a b c\na b c\n \na b c#\n\n<x>|é")]
    for r in quality_rules.assess(spark.createDataFrame(extra, "doc_id long, text string"), model).collect():
        n = plain_counts(dict(extra)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)


def test_quality_without_labels(spark):
    docs, labels = tables(spark, corpus(30))
    model = quality_rules.fit(docs, labels.filter("quality = 1"))
    assert all(r.kept == (not r.base_failed) for r in quality_rules.assess(docs, model).collect())


def test_toxicity(spark):
    rows = corpus(300)
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs.filter("doc_id < 200"), labels, 100)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert np.mean([got[r[0]].predicted == r[3] for r in held]) > 0.95
    hard = toxicity.score(frame(spark, hard_rows()), model).collect()
    assert len(hard) == len(hard_rows()) and all(0 <= r.score <= 1 for r in hard)


def test_toxicity_without_both_labels(spark):
    docs, labels = tables(spark, corpus(20))
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 0"))).collect()} == {0.0}


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        b = toxicity.Batch([" ".join(["w"] * n)])
        covered = {int(s) + k for s, size in zip(b.window_start, b.window_size) for k in range(int(size))}
        assert covered == set(range(n)) and len(b.window_start) >= 1


M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def slow_hash(word):
    """A word's hash, byte by byte."""
    total, weight = 0, 1
    for b in word:
        total, weight = (total + int(textkit._TABLE[b]) * weight) & M64, (weight * 0x9E3779B97F4A7C15) & M64
    x = (total + len(word) * 0x2545F4914F6CDD1D) & M64
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * k) & M64
    return x ^ (x >> 33)


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_margin(weights, bias, groups):
    """groups: a list of bins for each kind of n-gram."""
    return bias + hashed.SCALE * sum(np.mean([weights[b].astype(float) for b in g], axis=0) for g in groups if g)


def slow_bins(symbols, order, bits, block, base):
    out = []
    for k in range(len(symbols) - order + 1):
        value = 0
        for c in symbols[k : k + order]:
            value = (value * base + c) & M32
        out.append(((value * 0x9E3779B1 & M32) >> (32 - bits)) + (block << bits))
    return out


MANY = [t for _, t in hard_rows() if len(t or "") < 3000] + ["x", "ab", "日本 x", "Vilething! so BAD", "mnop стуф abc", "a b c d"]


def test_languages_against_slow_decoding(spark):
    docs, _ = tables(spark, corpus(120))
    model = language_id.fit(docs, 40)
    found = language_id.identify(spark.createDataFrame(list(enumerate(MANY)), "doc_id long, text string"), model).collect()
    for r in found:
        text = MANY[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
            continue
        raw = fold(text).encode()
        margins = slow_margin(model.weights, model.bias, [slow_bins(raw, o, language_id.BITS, i, 256) for i, o in enumerate(language_id.ORDERS)])
        loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, code)) for code in model.code.astype(float)]
        first, second = sorted(loss)[:2]
        assert r.score == pytest.approx(1 / sum(np.exp(first - x) for x in loss), abs=1e-4)
        assert r.lang_pred == model.languages[int(np.argmin(loss))] or second - first < 1e-3
        assert r.ambiguous == (second - first < language_id.MARGIN) or abs(second - first - language_id.MARGIN) < 1e-3


def test_quality_against_slow_scores(spark):
    docs, labels = tables(spark, corpus(120))
    model = quality_rules.fit(docs, labels, 60)
    for r in quality_rules.assess(spark.createDataFrame(list(enumerate(MANY)), "doc_id long, text string"), model).collect():
        text = MANY[r.doc_id] or ""
        groups = [slow_bins([ord(c) for c in text], o, quality_rules.BITS, i, 0x01000193) for i, o in enumerate(quality_rules.ORDERS)]
        groups.append([(slow_hash(w.encode()) >> (64 - quality_rules.BITS)) + (len(groups) << quality_rules.BITS) for w in words(text)])
        margin = float(np.ravel(slow_margin(model.weights, model.bias, groups))[0])
        assert r.quality == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-4)


def slow_logit(model, tokens):
    """One window, step by step."""
    p, h = model.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    inputs = []
    for w in tokens:
        row = {int(x): i + 1 for i, x in enumerate(model.lexicon)}.get(slow_hash(w), 0)
        grams = [(w + b"\0\0")[k : k + 3] for k in range(max(1, len(w) - 2))]
        chars = [p["char"][(int.from_bytes(g, "big") * 0x9E3779B1 & M32) >> (32 - toxicity.CHAR_BITS)] for g in grams]
        inputs.append(np.concatenate([p["word"][row], np.mean(chars, axis=0)]).astype(float))
    states = np.zeros((max(1, len(inputs)), 2 * h))
    for side in (0, 1):
        state = np.zeros(h)
        for t in range(len(inputs)) if side == 0 else range(len(inputs) - 1, -1, -1):
            g = inputs[t] @ p[f"w{side}"] + p[f"b{side}"]
            z, r = sigmoid(g[:h] + state @ p[f"u{side}"][:, :h]), sigmoid(g[h : 2 * h] + state @ p[f"u{side}"][:, h:])
            state = (1 - z) * state + z * np.tanh(g[2 * h :] + (r * state) @ p[f"v{side}"])
            states[t, side * h : (side + 1) * h] = state
    weight = np.exp(states @ p["attend"])
    return float((weight / weight.sum()) @ states @ p["out"] + p["bias"][0])


def test_toxicity_against_slow_network(spark):
    docs, labels = tables(spark, corpus(120))
    model = toxicity.fit(docs, labels, 50)
    for r in toxicity.score(spark.createDataFrame(list(enumerate(MANY)), "doc_id long, text string"), model).collect():
        tokens = [w.strip(string.punctuation.encode()) or w for w in (w.encode() for w in words(MANY[r.doc_id], fold=True))]
        windows = [tokens[a : a + toxicity.WINDOW] for a in range(0, max(1, len(tokens) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)]
        logit = max(slow_logit(model, w) for w in windows)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(model.slope * logit + model.offset))), abs=1e-3)
        assert r.predicted == (r.score >= 0.5)


def test_a_score_does_not_depend_on_the_batch(spark):
    docs, labels = tables(spark, corpus(60))
    model = toxicity.fit(docs, labels, 30)
    alone = [float(toxicity.text_logits(model, [t])[0]) for t in MANY]
    assert toxicity.text_logits(model, MANY).tolist() == pytest.approx(alone, abs=1e-4)


def test_samples_are_bounded_in_bytes(spark):
    rows = [(i, "x" * 1000) for i in range(40)] + [(100, "y" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows] + [(3, 1), (3, 0), (3, 0)], "doc_id long, label int")
    got = hashed.training_rows(docs, labels, 20, 5000).collect()
    assert sorted((r.label, len(r.text)) for r in got) == [(0, 1000)] * 5 + [(1, 9000)]
    assert len(hashed.training_rows(docs, labels, 20).collect()) == 21


def test_gradients():
    """Backpropagation against differences of the loss."""
    rng = np.random.default_rng(3)
    texts, y = ["good words here", "vile words there vile"], np.array([0, 1])
    model = toxicity.Model(np.sort(toxicity.Batch(texts).hash), {})
    init = lambda *s: rng.standard_normal(s) * 0.5
    h = toxicity.HIDDEN
    model.p = {"word": init(len(model.lexicon) + 1, toxicity.WORD_DIM), "char": init(1 << toxicity.CHAR_BITS, toxicity.CHAR_DIM), "attend": init(2 * h), "out": init(2 * h), "bias": init(1)}
    for s in (0, 1):
        model.p |= {f"w{s}": init(toxicity.WORD_DIM + toxicity.CHAR_DIM, 3 * h), f"u{s}": init(h, 2 * h), f"v{s}": init(h, h), f"b{s}": init(3 * h)}
    batch = toxicity.Batch(texts)
    grid, size = batch.grid(np.arange(2))
    _, x = toxicity.inputs(model, batch)

    def loss():
        z = toxicity.forward(model, x, grid, size)[0].astype(float)
        return np.log1p(np.exp(-np.where(y == 1, z, -z))).sum()

    z, kept = toxicity.forward(model, x, grid, size, train=True)
    grads, _ = toxicity.backward(model, x, grid, toxicity._sigmoid(z) - y, kept)
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        for k in rng.choice(flat.size, min(3, flat.size), replace=False):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-3, abs=3e-3)
