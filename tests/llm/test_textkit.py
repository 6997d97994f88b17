import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from provena.llm import packing, textkit
from provena.llm.textkit import Words, anchors, byte_values, rolling, window_min

TEXT = st.text(st.sampled_from(list("ab é\n\t　\x0bZ")), max_size=40) | st.none()


@settings(deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_and_hashes(texts):
    w = Words(texts, lower=True)
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x.encode() for ws in want for x in ws]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == flat
    seen = {}
    assert all(seen.setdefault(h, b) == b for h, b in zip(w.hash.tolist(), flat)) and len(seen) == len(set(flat))


def test_window_min():
    x = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 16, 50):
        assert window_min(x, width).tolist() == [min(x[i : i + width]) for i in range(51 - width)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=4), st.integers(2, 8), st.integers(1, 4))
def test_equal_strings_have_equal_anchors(texts, length, gram):
    gram = min(gram, length)
    w = Words(texts)
    lengths = np.diff(w.text_at) - 1
    text, at, n, place, h = anchors(byte_values(w.data), w.text_at[:-1], lengths, length, gram)
    found, places = {}, []
    for t, a, k, p, x in zip(text, at, n, place, h):
        for s in range(a, a + k):
            string = texts[t][s : s + length]
            assert found.setdefault(string, (x, p - s)) == (x, p - s)
            places.append((t, s))
    assert sorted(places) == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - length + 1)]


def test_rolling_is_positional():
    v = np.array([5, 7, 5, 7, 9], np.uint64)
    r = rolling(v, 2)
    assert r[0] == r[2] and len(set(r.tolist())) == 3 and len(rolling(v, 6)) == 0


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    cols = [np.sort(rng.integers(0, 1 << 63, 9).astype(np.uint64)), rng.integers(-5, 5, 9), rng.integers(0, 9, 9).astype(np.int32)]
    back = packing.unpack(packing.pack(cols), [np.uint64, np.int64, np.int32])
    assert all((a == b).all() for a, b in zip(cols, back))
    empty = packing.unpack(packing.pack([c[:0] for c in cols]), [np.uint64, np.int64, np.int32])
    assert all(len(x) == 0 for x in empty)


def test_spans_are_hashed_block_by_block():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3 * textkit.BLOCK, dtype=np.uint8)
    start = rng.integers(0, len(data), 4000)
    end = np.minimum(start + rng.integers(0, 900, 4000), len(data))
    start, end = np.append(start, [0, 0, len(data), textkit.BLOCK, 5]), np.append(end, [len(data), 0, len(data), 2 * textkit.BLOCK, textkit.BLOCK])
    whole = textkit.span_hash(textkit.prefix_sums(textkit.byte_values(data)), start, end)
    assert (textkit.hash_spans(data, start, end) == whole).all()


def test_a_long_text_takes_memory_in_proportion():
    """Peaks of what one text needs at once, per byte of it."""
    import random
    import tracemalloc

    from provena.llm import decontamination, hashed, lm_scoring, near_dedup, quality_rules, repeats, toxicity

    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(50000)}" for _ in range(300_000))
    slices = lambda unit, n, g: [len(textkit.anchors(v, s, m, n, g)[0]) for v, s, m, _, _ in repeats.sliced([text], unit, n)]
    work = {
        "rules": lambda: quality_rules.counts(textkit.Words([text])),
        "weights": lambda: hashed.linear(textkit.Words([text]), np.zeros((4 << 15, 1), np.float32), (3, 4), 15, True, True),
        "languages": lambda: hashed.linear(textkit.Words([text]), np.zeros((2 << 14, 15), np.float32), (2, 3), 14),
        "network": lambda: toxicity.Batch([text]),
        "templates": lambda: decontamination.Canonical([text]),
        "bytes": lambda: slices("bytes", 400, 48),
        "words": lambda: slices("words", 20, 4),
        "sets": lambda: near_dedup.shingles([text]),
        "tokens": lambda: lm_scoring.sequences([text]),
    }
    for name, run in work.items():
        run()
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50 * len(text) + 40e6, (name, peak / len(text))


def test_characters_of_any_script():
    from provena.llm import hashed

    texts = ["aé日🎉b", None, "", "ab", "日本語x日本語"]
    words = textkit.Words(texts)
    points, at = hashed.code_points(words.data)
    assert "".join(map(chr, points)) == "\n".join([t or "" for t in texts] + [""]) and (np.diff(at) >= 1).all()
    (bins, bounds), _ = hashed.gram_bins(words, (3, 4), 15, chars=True)
    assert np.diff(bounds).tolist() == [max(0, len(t or "") - 2) for t in texts] and bins[-5] == bins[-1]
