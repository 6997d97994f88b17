"""Language-model scoring with an interpolated modified Kneser-Ney bigram model.

Counting. Every training text is a sequence BEGIN, words, END. Tasks count bigrams
of 64-bit word hashes, and send them by the second word to shards; words that hold
over 1/1000 of all tokens are further salted by the first word, so that no shard
grows with one word. A shard writes its bigrams as a sorted hash array with counts,
and its words likewise with raw and continuation counts. A second exchange gathers
how many bigrams of count 1, 2 and more follow each context.

Scoring. Workers memory-map the shards and look up sorted hashes by binary search;
nothing of the model goes through the driver but the totals and the salted words,
which are under 2000 by the way they are chosen.

    p(w|v) = max(c(v,w) - D(c), 0) / c(v) + gamma(v) p(w)
    p(w)   = max(k(w) - d(k), 0) / K + gamma / (V + 1)

k(w): number of distinct words before w, K: of distinct bigrams. Unknown words share
one part of V + 1. Null and empty texts are the single token END. Rows with equal ids
are scored separately; a null id is in the training set. With no training text every
token has probability 1 of 1 (score 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, map_bytes, saved, seg_sum, session, shared_dir, write_bytes
from .packing import pack as _pack
from .packing import unpack as _unpack
from .textkit import U64, Words, mix

BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543211)
#: A word is salted when it may hold this share of all tokens.
HOT_SHARE = 1 / 1000
#: Bytes of training text to a shard, and bigrams a task gathers before it sends them.
SHARD_BYTES, FLUSH = 8 << 20, 1 << 20
#: Tokens looked up at once, however long a text is.
STEP = 1 << 20


def bigram_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U64(0x9E3779B97F4A7C15) + (word ^ (word >> U64(29))))


def sequences(texts: list[str | None]):
    """Hashes of all tokens with END after each text, and the text bounds."""
    words = Words(texts, lower=True)
    n = words.counts + 1
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    tokens = np.full(bounds[-1], END, U64)
    place = np.ones(bounds[-1], bool)
    place[bounds[1:] - 1] = False
    tokens[place] = words.hash
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = BEGIN
    return tokens, before, bounds


def shard_of(before: np.ndarray, word: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    salted = np.isin(word, hot)
    return (np.where(salted, mix(word + before), word) >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(word), np.int64)


def summed(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys in order, with the sum of each value column."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[head], *(np.add.reduceat(v[order], head) for v in values))


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with over a third of HOT_SHARE of this task's tokens, and the token count (word 0).

    Rare words are let go now and then, which takes under 1/20 of HOT_SHARE from a count:
    a word of HOT_SHARE of all tokens keeps over half of them over all tasks.
    """
    keys, counts, total = np.empty(0, U64), np.empty(0, np.int64), 0
    for b in chunks(batches):
        tokens, _, _ = sequences(b.column(0).to_pylist())
        total += len(tokens)
        k, c = np.unique(tokens, return_counts=True)
        keys, counts = summed(np.concatenate([keys, k]), np.concatenate([counts, c]))
        if len(keys) > FLUSH:
            keep = counts > HOT_SHARE / 20 * total
            keys, counts = keys[keep], counts[keep]
    keep = counts >= HOT_SHARE / 3 * total
    yield pa.record_batch({"word": np.append(keys[keep], U64(0)).view(np.int64), "n": np.append(counts[keep], total)})


def _count(hot: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            v, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((v, w))
            v, w, c = v[order], w[order], c[order]
            head = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
            v, w, c = v[head], w[head], np.add.reduceat(c, head)
            shard = shard_of(v, w, hot, bits)
            by = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[by])) + 1
            ids, blobs = [], []
            for part in np.split(by, cuts):
                ids.append(int(shard[part[0]]))
                blobs.append(_pack([w[part], v[part], c[part].astype(np.uint32)]))
            return pa.record_batch({"shard": pa.array(ids, pa.int32()), "data": pa.array(blobs, pa.binary())})

        size = 0
        for b in chunks(batches):
            tokens, before, _ = sequences(b.column(0).to_pylist())
            order = np.argsort(key := bigram_key(before, tokens))
            head = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(order) else order
            c = np.diff(np.append(head, len(order)))
            first = order[head]
            held.append((before[first], tokens[first], c))
            size += len(first)
            if size > FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _class_counts(c: np.ndarray) -> list[int]:
    return [int((c == i).sum()) for i in (1, 2, 3, 4)]


def _gather(path: str, hot: np.ndarray, bits: int):
    """Write a shard's bigrams and words; send on what its contexts and totals need."""

    def run(parts: pa.Table) -> pa.Table:
        shard = parts.column("shard")[0].as_py()
        cols = [_unpack(x.as_py(), [U64, U64, np.uint32]) for x in parts.column("data")]
        w, v, c = (np.concatenate(x) for x in zip(*cols, strict=True))
        del cols
        order = np.argsort(key := bigram_key(v, w))
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        c = np.add.reduceat(c[order].astype(np.int64), head)
        w, v, key = w[order][head], v[order][head], key[head]
        write_bytes(f"{path}/bigrams-{shard}", [np.array([len(key)], np.int64).data, key.data, np.minimum(c, 0xFFFFFFFF).astype(np.uint32).data])
        words, raw, k = summed(w, c, np.ones(len(c), np.int64))
        salted = np.isin(words, hot)
        cold = ~salted
        write_bytes(f"{path}/words-{shard}", [np.array([cold.sum()], np.int64).data, words[cold].data, raw[cold].astype(np.int64).data, k[cold].astype(np.int64).data])
        contexts = summed(v, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
        to = (contexts[0] >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(contexts[0]), np.int64)
        kind, target, blobs = [], [], []
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
            kind.append("context")
            target.append(int(to[part[0]]))
            blobs.append(_pack([contexts[0][part], *(x[part].astype(np.uint32) for x in contexts[1:])]))
        totals = [int(c.sum()), int(cold.sum()), len(key), *_class_counts(c), *_class_counts(k[cold]), int((k[cold] > 2).sum()), int((k[cold] == 1).sum()), int((k[cold] == 2).sum())]
        kind.append("totals")
        target.append(-1)
        blobs.append(np.array(totals, np.int64).tobytes())
        if salted.any():
            kind.append("hot")
            target.append(-1)
            blobs.append(words[salted].tobytes() + raw[salted].astype(np.int64).tobytes() + k[salted].astype(np.int64).tobytes())
        return pa.table({"kind": kind, "target": pa.array(target, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _contexts(path: str):
    def run(parts: pa.Table) -> pa.Table:
        shard = parts.column("target")[0].as_py()
        cols = [_unpack(x.as_py(), [U64, *[np.uint32] * 4]) for x in parts.column("blob")]
        key, *n = (np.concatenate(x) for x in zip(*cols, strict=True))
        key, *n = summed(key, *(x.astype(np.int64) for x in n))
        write_bytes(f"{path}/contexts-{shard}", [np.array([len(key)], np.int64).data, key.data, *(x.astype(np.int64).data for x in n)])
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(key)], pa.int64())})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of
    events seen 1 to 4 times; a half where those don't give a value inside (0, count)."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [c - (c + 1) * y * b / a if a else -1.0 for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(x if 0 < x < c else 0.5 for c, x in enumerate(d, 1))])


@dataclass
class Model:
    """Where the shards are, the totals, and the words that were salted."""

    path: str
    bits: int
    tokens: int
    types: int
    pairs: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    gamma: float
    hot: np.ndarray
    hot_raw: np.ndarray
    hot_kinds: np.ndarray


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Count a bigram model over every text of docs."""
    spark = session(docs)
    docs = docs.select(F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / SHARD_BYTES)))))
    heavy = saved(spark, docs.mapInArrow(_heavy, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "heavy")
    total = heavy.filter("word = 0").agg(F.sum("n")).first()[0] or 0
    # under 2 / HOT_SHARE words can have that many tokens
    hot_rows = heavy.filter("word <> 0").filter(F.col("n") >= total * (HOT_SHARE / 2)).select("word").collect()
    hot = np.sort(np.array([r[0] for r in hot_rows], np.int64).view(U64))
    path = shared_dir(spark, "lm")
    counted = docs.mapInArrow(_count(hot, bits), "shard int, data binary")
    sent_path = f"{path}/sent"
    counted.groupBy("shard").applyInArrow(_gather(path, hot, bits), "kind string, target int, blob binary").write.partitionBy("kind").parquet(sent_path)
    sent = spark.read.schema("target int, blob binary, kind string").parquet(sent_path)
    spark_contexts = sent.filter("kind = 'context'").select("target", "blob").groupBy("target").applyInArrow(_contexts(path), "shard int, n long")
    spark_contexts.agg(F.sum("n")).collect()
    totals = np.zeros(14, np.int64)
    kinds: dict[int, list[int]] = {int(h): [0, 0] for h in hot}
    for kind, blob in sent.filter("kind <> 'context'").select("kind", "blob").toLocalIterator():
        if kind == "totals":
            totals += np.frombuffer(bytes(blob), np.int64)
            continue
        words, raw, k = np.frombuffer(bytes(blob), np.int64).reshape(3, -1)
        for a, b, c in zip(words.view(U64), raw, k, strict=True):
            kinds[int(a)][0] += int(b)
            kinds[int(a)][1] += int(c)
    hot_raw, hot_kinds = (np.array([kinds[int(h)][i] for h in hot], np.int64) for i in (0, 1))
    seen = hot_raw > 0
    hot, hot_raw, hot_kinds = hot[seen], hot_raw[seen], hot_kinds[seen]
    n, v, pairs = (int(x) for x in totals[:3])
    v += len(hot)
    word_classes = [int(totals[7 + i]) + x for i, x in enumerate(_class_counts(hot_kinds))]
    d = discounts(word_classes)
    m1, m2 = word_classes[0], word_classes[1]
    m3 = int(totals[11]) + int((hot_kinds > 2).sum())
    gamma = float((d[1] * m1 + d[2] * m2 + d[3] * m3) / pairs) if pairs else 1.0
    return Model(path, bits, n, v, pairs, discounts([int(x) for x in totals[3:7]]), d, gamma, hot, hot_raw, hot_kinds)


#: Shards in hand, and bytes of them at most where a file system has no memory maps.
_open: dict[str, list] = {}
CACHE_BYTES = 128 << 20


def _shard(model: Model, kind: str, shard: int, kinds: list[type]) -> list[np.ndarray]:
    """A shard's sorted keys and columns, memory-mapped once per worker. Shards that had to be
    fetched leave again, the longest unused first, when they are too many."""
    name = f"{model.path}/{kind}-{shard}"
    if name in _open:
        _open[name] = _open.pop(name)
        return _open[name]
    try:
        raw = map_bytes(name)
        n, at, cols = int(raw[:8].view(np.int64)[0]), 8, []
        for k in kinds:
            cols.append(raw[at : at + n * np.dtype(k).itemsize].view(k))
            at += n * np.dtype(k).itemsize
    except FileNotFoundError:
        cols = [np.empty(0, k) for k in kinds]  # no training text has a bigram in this shard
    _open[name] = cols
    held = [k for k, c in _open.items() if not isinstance(c[0], np.memmap)]
    size = sum(x.nbytes for k in held for x in _open[k])
    while size > CACHE_BYTES and len(held) > 1:
        size -= sum(x.nbytes for x in _open.pop(held.pop(0)))
    return cols


def _find(model: Model, kind: str, shards: np.ndarray, keys: np.ndarray, kinds: list[type]) -> list[np.ndarray]:
    """The columns of each key, 0 where it is absent."""
    out = [np.zeros(len(keys), np.int64) for _ in kinds[1:]]
    order = np.lexsort((keys, shards))
    for part in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(order) else []:
        have, *cols = _shard(model, kind, int(shards[part[0]]), kinds)
        if len(have):
            at = np.minimum(np.searchsorted(have, keys[part]), len(have) - 1)
            hit = have[at] == keys[part]
            for o, c in zip(out, cols, strict=True):
                o[part[hit]] = c[at[hit]]
    return out


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def score_texts(model: Model, texts: list[str | None]):
    """n_tokens, n_known, base score and model score of each text."""
    tokens, before, bounds = sequences(texts)
    out = np.zeros((3, len(bounds) - 1))
    for a in range(0, len(tokens), STEP):
        z = min(len(tokens), a + STEP)
        own = np.clip(bounds, a, z) - a
        for row, values in zip(out, _score_tokens(model, tokens[a:z], before[a:z]), strict=True):
            row += seg_sum(values, own)
    return np.diff(bounds), out[0].astype(np.int64), out[1], out[2]


def _score_tokens(model: Model, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each token is known, and its base and model log10 probability."""
    words, back = np.unique(tokens, return_inverse=True)
    raw, kinds = _find(model, "words", _top(words, model.bits), words, [U64, np.int64, np.int64])
    if len(model.hot):
        at = np.minimum(np.searchsorted(model.hot, words), len(model.hot) - 1)
        hit = model.hot[at] == words
        raw[hit], kinds[hit] = model.hot_raw[at[hit]], model.hot_kinds[at[hit]]
    contexts, context_back = np.unique(before, return_inverse=True)
    seen, n1, n2, n3 = _find(model, "contexts", _top(contexts, model.bits), contexts, [U64, *[np.int64] * 4])
    keys, first, pair_back = np.unique(bigram_key(before, tokens), return_index=True, return_inverse=True)
    (c,) = _find(model, "bigrams", shard_of(before[first], tokens[first], model.hot, model.bits), keys, [U64, np.uint32])
    d, e = model.pair_discounts, model.word_discounts
    word_p = np.maximum(kinds - e[np.minimum(kinds, 3)], 0) / max(model.pairs, 1) + model.gamma / (model.types + 1)
    total = np.maximum(seen, 1)
    gamma = np.where(seen > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / total, 1.0)[context_back]
    pair = np.maximum(c - d[np.minimum(c, 3)], 0)[pair_back] / total[context_back]
    p = np.log10(pair + gamma * word_p[back])
    base = np.log10((raw + 0.5) / (model.tokens + 0.5 * (model.types + 1)))[back]
    return (raw > 0).astype(np.float64)[back], base, p


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score, score and perplexity of each row."""
    shape = docs.select(*keep).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, len(keep), 4 << 20):
            n, known, base, p = score_texts(model, b.column(b.num_columns - 1).to_pylist())
            new = {"n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), model.tokens), "base_score": base, "score": p, "perplexity": 10 ** (-p / n)}
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(shape))), *(pa.array(x) for x in new.values())], names=[*(f.name for f in shape), *new])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{out}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
