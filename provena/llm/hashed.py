"""Hashed n-gram features of whole texts and logistic regression over them, in numpy.

A text's features are the relative frequencies of its n-grams, each hashed to a bin of
its group's block; so a linear score is a mean of bin weights, and scoring a text
needs one table lookup per n-gram and no feature vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import chunks, saved, session
from .textkit import U64, Words

#: Features are frequencies times this, so that weights of some units can tell texts apart.
SCALE = 40.0


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the byte that each starts at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    first = data[at].astype(np.uint32)
    point = np.where(first < 0x80, first, first & (np.uint32(0x7F) >> np.minimum(size, 6).astype(np.uint32)))
    for i in range(1, 4):
        more = size > i
        point[more] = (point[more] << np.uint32(6)) | (data[at[more] + i] & 63)
    return point, at


def gram_bins(words: Words, orders: tuple[int, ...], bits: int, with_words: bool = False, chars: bool = False):
    """Per group of n-grams: the bin of every n-gram of the batch, and the bounds of each text.

    orders: numbers of bytes, or of characters with chars; words add a group of their own.
    """
    data, at = words.data, words.text_at
    if chars:
        data, places = code_points(words.data)
        at = np.searchsorted(places, at)
    out = []
    for block, order in enumerate(orders):
        ends = np.maximum(at[1:] - 1 - (order - 1), at[:-1])
        n = len(data) - order + 1
        if n <= 0:
            out.append((np.empty(0, np.int64), np.zeros(len(at), np.int64)))
            continue
        value = np.zeros(n, np.uint32)
        for i in range(order):
            value = value * np.uint32(0x01000193) + data[i : n + i] if chars else (value << np.uint32(8)) | data[i : n + i]
        bins = ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32) + np.int32(block << bits)
        inside = np.zeros(n + 1, np.int8)
        np.add.at(inside, at[:-1][ends > at[:-1]], 1)
        np.add.at(inside, ends[ends > at[:-1]], -1)
        bins = bins[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        out.append((bins, np.append(0, np.cumsum(ends - at[:-1]))))
    if with_words:
        out.append(((words.hash >> U64(64 - bits)).astype(np.int64) + (len(orders) << bits), words.first))
    return out


#: n-grams weighed at once: what is held does not grow with a text.
STEP = 1 << 16


def linear(words: Words, weights: np.ndarray, orders: tuple[int, ...], bits: int, with_words: bool = False, chars: bool = False) -> np.ndarray:
    """Sum over groups of the mean weight of a text's n-grams; weights: bins x outputs."""
    total = np.zeros((len(words.text_at) - 1, weights.shape[1]))
    for bins, bounds in gram_bins(words, orders, bits, with_words, chars):
        mean = 1 / np.maximum(np.diff(bounds), 1)
        for a in range(0, len(bins), STEP):
            z = min(len(bins), a + STEP)
            first, last = np.searchsorted(bounds, a, "right") - 1, np.searchsorted(bounds, z, "left")
            at = np.clip(bounds[first:last], a, z)
            full = np.flatnonzero(np.append(at[1:], z) > at)
            own = first + full
            total[own] += np.add.reduceat(weights[bins[a:z]], at[full] - a, axis=0) * mean[own, None]
    return total * SCALE


#: Rows of a table of labels or of a sample's ids up to which it is broadcast; larger ones are joined.
BROADCAST_ROWS = 100_000
OVERSAMPLE = 8
#: Bytes of text that the rows of one label have together, but for one row.
TRAIN_BYTES = 16 << 20


def training_rows(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """label and text (null as empty) of up to `most` documents of each label value, the first
    by a hash of their ids, and of those the first that have most_bytes together (one at least).
    docs: doc_id, text; labels: doc_id, label; null labels are none.

    Only ids are ranked, and of a label's ids only those whose hash is under a share that
    passes about OVERSAMPLE times as many as wanted; the lowest are all among them, however
    many a label has. Texts are read once, for the chosen ids. A document that has several
    rows or labels counts once.
    """
    spark = session(docs)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("place", place)
    share = known.groupBy("label").agg((F.lit(float((1 << 40) * OVERSAMPLE * most)) / F.count(F.lit(1))).alias("cut"))
    # broadcast behind a count: planned as a shuffle it would deal all ids by their label first
    share = saved(spark, share, "shares")
    low = known.join(F.broadcast(share) if share.count() <= BROADCAST_ROWS else share, "label").filter("place < cut")
    order = Window.partitionBy("label").orderBy("place", "doc_id")
    ranked = low.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("doc_id", "label", "place")
    chosen = saved(spark, ranked, "sample")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    rows = saved(spark, rows.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text")), "training")
    sizes = rows.select("doc_id", "label", "place", F.octet_length("text").cast("long").alias("n"))
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    few = sizes.withColumn("before", before).withColumn("n", F.col("before") + F.col("n")).filter((F.col("n") <= most_bytes) | (F.col("before") == 0))
    return rows.join(few.select("doc_id"), "doc_id", "left_semi").select("label", "text")


def sample(docs: DataFrame, labels: DataFrame, most: int, orders: tuple[int, ...], bits: int, with_words: bool = False, lower: bool = True, chars: bool = False) -> list[tuple]:
    """(label, bins, values) with the features of the whole text of each training row. The bounds
    on rows and bytes make it safe to collect."""
    rows = training_rows(docs, labels, most)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            words = Words(b.column(1).to_pylist(), lower=lower)
            groups = gram_bins(words, orders, bits, with_words, chars)
            cols, values = [], []
            for i in range(b.num_rows):
                keys, weights = [], []
                for bins, bounds in groups:
                    k, c = np.unique(bins[bounds[i] : bounds[i + 1]], return_counts=True)
                    keys.append(k.astype(np.int32))
                    weights.append((c / max(1, c.sum()) * SCALE).astype(np.float32))
                cols.append(np.concatenate(keys).tobytes())
                values.append(np.concatenate(weights).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], names=["label", "bins", "values"])

    out = rows.mapInArrow(run, f"label {kind}, bins binary, values binary").collect()
    # a fixed order, whatever the partitions were
    return sorted(((r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in out), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


def fit(rows: list[tuple], targets: np.ndarray, n_bins: int, rounds: int = 60, rate: float = 0.5, decay: float = 1e-6):
    """Weights (n_bins x outputs) and biases of logistic regressions of all outputs (+-1, 0 for
    no opinion), by full-batch AdaGrad. rows: from sample()."""
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    bins = np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.int32)
    value = np.concatenate([r[2] for r in rows]) if rows else np.empty(0, np.float32)
    used, slot = np.unique(bins, return_inverse=True)
    by_bin = np.argsort(slot, kind="stable")
    heads = np.append(0, np.cumsum([len(r[1]) for r in rows]))[:-1].astype(np.int64)
    bin_heads = np.flatnonzero(np.append(True, np.diff(slot[by_bin]) > 0)) if len(slot) else np.empty(0, np.int64)
    weights = np.zeros((n_bins, targets.shape[1]), np.float32)
    bias = np.zeros(targets.shape[1])
    if not len(used):
        return weights, bias
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(np.float32)
        n = max(1, np.count_nonzero(y))
        w, g2, b, b2 = np.zeros(len(used), np.float32), np.full(len(used), 1e-8, np.float32), 0.0, 1e-8
        for _ in range(rounds):
            f = np.add.reduceat(value * w[slot], heads) + b
            pull = -y / (1 + np.exp(np.clip(y * f, -30, 30))) / n
            g = np.add.reduceat((value * pull[owner])[by_bin], bin_heads) + decay * w
            g2 += g * g
            w -= (rate * g / np.sqrt(g2)).astype(np.float32)
            gb = float(pull.sum())
            b2 += gb * gb
            b -= rate * gb / np.sqrt(b2)
        weights[used, k] = w
        bias[k] = b
    return weights, bias


def platt(score: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps with a light prior."""
    a, b = 1.0, 0.0
    y = positive.astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([(weight * (p - y) * score).sum() + 0.01 * (a - 1), (weight * (p - y)).sum() + 0.01 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * score * score).sum() + 0.01, (v * score).sum()], [(v * score).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        step *= min(1.0, 2.0 / max(size, 1e-12))
        a, b = a - step[0], b - step[1]
        if size < 1e-8:
            break
    return float(a), float(b)


def per_row(docs: DataFrame, keep: tuple[str, ...], columns: str, work: Callable[[list[str | None], pa.RecordBatch], list], extra: tuple[Column, ...] = ()) -> DataFrame:
    """keep plus the columns that work(texts, batch) gives for a batch of whole texts."""
    shape: T.StructType = docs.select(*keep).schema
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shape)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, len(keep)):
            new = work(b.column(len(keep)).to_pylist(), b)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(x if isinstance(x, pa.Array) else pa.array(x) for x in new)], names=[*shape.names, *names])

    return docs.select(*keep, F.col("text").alias("__text"), *extra).mapInArrow(run, head + columns)
