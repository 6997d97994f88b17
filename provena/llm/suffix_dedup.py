"""Exact substring deduplication on suffix arrays.

Pieces of text that share an anchor (see repeats) are joined to shards of bounded
size. Of each shard a suffix array is sorted by prefix tripling (or doubling), and its
Burrows-Wheeler transform taken. Where neighbouring suffixes differ is then found by
breadth-first backward extension: from the intervals of single symbols, level l
extends every interval of a string of length l by each symbol before it, and an
interval whose right end has no value yet has a common prefix of l there. Common
prefixes come out by increasing value, and the search stops at the wanted length:
suffixes with no boundary between them share at least that much.

Every byte that lies in a string of min_bytes bytes found anywhere else, in any text
or in the same one, is removed - all occurrences are. Texts are UTF-8 bytes, null is
empty; texts under min_bytes have nothing to remove; rows with equal texts are copies
whatever their ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, runs, saved, trim
from .repeats import KEY, covered, distinct_texts, find_pieces, judged, shards, text_key

MIN_BYTES, GRAM = 400, 48
#: Bytes of a shard, and of one anchor's classes beyond which they are split by a longer gram.
SHARD_BYTES, ANCHOR_BYTES = 1 << 19, 1 << 20


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes of symbols 1-256 in which each 0 is an end mark, smaller than all
    else and, among end marks, in order of place."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | np.where(to_end >= i, padded[i : i + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (to_end[order[1:]] < 7)
    del key, sorted_key, padded
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, size)
    # a window up to an end mark has a rank of its own, so what lies beyond never decides
    width, bits = 7, max(1, (n - 1).bit_length())
    triple = 3 * bits < 64
    open_slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_slots):
        at = order[open_slots]
        pair = (rank[at] << np.int64(bits)) | rank[at + width]
        if triple:
            pair = (pair << np.int64(bits)) | rank[np.minimum(at + 2 * width, n - 1)]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[open_slots] = at
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        rank[at] = np.repeat(open_slots[head], size)
        open_slots = open_slots[np.repeat(size > 1, size)]
        width *= 3 if triple else 2
    return order


def boundaries(symbols: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """For each rank, the length of the prefix shared with the rank before, where that is
    under `stop`, else -1 (0 at rank 0)."""
    n = len(symbols)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # the rank of the suffix one symbol longer
    step[by_symbol] = np.arange(n)
    front = symbols[order]
    depth = np.full(n + 1, -1, np.int32)
    depth[0] = depth[n] = 0
    marks = int(np.searchsorted(front, 1))
    new = np.ones(n, bool)
    new[max(marks, 1) :] = front[max(marks, 1) :] != front[max(marks, 1) - 1 : -1]
    left = np.flatnonzero(new)
    right = np.append(left[1:], n) - 1
    level = 0
    while len(left):
        ends = right + 1
        unset = depth[ends] < 0
        left, right = left[unset], right[unset]
        depth[ends[unset]] = level
        level += 1
        if level >= stop or not len(left):
            break
        size = right - left + 1
        ranks = runs(left, size)
        keep = bwt[ranks] > 0
        owner = np.repeat(np.arange(len(size)), size)[keep]
        to = step[ranks[keep]]
        by = np.argsort(to)
        to, owner = to[by], owner[by]
        if not len(to):
            break
        new = np.ones(len(to), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (front[to[1:]] != front[to[:-1]])
        head = np.flatnonzero(new)
        left, right = to[head], to[np.append(head[1:], len(to)) - 1]
    return depth[:n]


def repeated_starts(pieces: list[bytes], twice: np.ndarray, length: int) -> np.ndarray:
    """For every byte of the pieces, each followed by one more place: whether a string of
    the length starts there that occurs again, in this or another piece, or whose piece
    itself occurs twice."""
    raw = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes) - 1
    symbols = raw.astype(np.uint16) + np.uint16(1)
    symbols[ends] = 0
    order = suffix_array(symbols)
    cut = boundaries(symbols, order, length) >= 0
    head = np.flatnonzero(cut)
    size = np.diff(np.append(head, len(order)))
    found = np.zeros(len(symbols), bool)
    found[order[np.repeat(size > 1, size)]] = True
    room = np.repeat(ends, sizes) - np.arange(len(symbols)) >= length
    return found | (np.repeat(twice, sizes) & room)


def _shard(length: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        data = part.column("data").to_pylist()
        found = repeated_starts(data, part.column("size").to_numpy() > 1, length)
        edge = np.diff(found.view(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        starts = np.cumsum([0, *(len(d) + 1 for d in data[:-1])])
        owner = np.searchsorted(starts, begin, "right") - 1
        take = pa.array(owner)
        trim()
        return pa.table({"h": part.column("h").take(take), "g": part.column("g").take(take), "off": pa.array((begin - starts[owner]).astype(np.int32)), "len": pa.array((end - begin).astype(np.int32))})

    return run


def repeats(texts: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, most: int = ANCHOR_BYTES) -> DataFrame:
    """k1, k2, at, n: runs of starts, in distinct texts, of strings that occur again."""

    def judge(found: DataFrame) -> DataFrame:
        # an anchor with one class: its pieces are equal, so each start of each occurs again
        alone = found.filter("classes = 1").select("h", "g", F.lit(0).alias("off"), F.col("n").alias("len"))
        mixed = shards(found.filter("classes > 1"), texts, "bytes", min_bytes, SHARD_BYTES)
        rows = mixed.select("shard", "h", "g", "size", "data").groupBy("shard").applyInArrow(_shard(min_bytes), "h long, g long, off int, len int")
        return saved(texts.sparkSession, alone.unionByName(rows), "judged")

    gram = min(gram, min_bytes)
    pieces = find_pieces(texts, "bytes", min_bytes, gram)
    found = judged(pieces, texts, "bytes", min_bytes, gram, most, judge)
    return pieces.join(found, ["h", "g"]).select(*KEY, (F.col("at") + F.col("off")).alias("at"), F.col("len").alias("n"))


def removed_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, with_text: bool = False, most: int = ANCHOR_BYTES, over_words: int | None = None, sure_bytes: int = MIN_BYTES) -> DataFrame:
    """For each text key of docs (doc_id, text) that loses bytes: k1, k2, whole (all bytes go),
    n_removed, n_spans, kept_sha256, spans, and with_text the bytes kept. With over_words a
    run of repeated bytes goes only if it has more words than that, or sure_bytes bytes."""
    texts = distinct_texts(docs)
    found = repeats(texts, min_bytes, gram, most).groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    whole = (F.col("copies") > 1) & (F.octet_length("text") >= min_bytes)
    if over_words is not None:
        n_words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
        whole &= (F.octet_length("text") >= sure_bytes) | (n_words > over_words)
    rows = texts.filter(~whole).join(found, list(KEY)).select(*KEY, "starts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("removed", "spans", "sha", "list", "kept")}
            starts = b.column(2)
            bounds, flat = starts.offsets.to_numpy() - starts.offsets[0].as_py(), starts.flatten()
            at, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            for i, text in enumerate(b.column(3).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                begin, end = covered(at[bounds[i] : bounds[i + 1]], n[bounds[i] : bounds[i + 1]], min_bytes)
                if over_words is not None:
                    goes = np.array([y - x >= sure_bytes or len(raw[x:y].split()) > over_words for x, y in zip(begin, end, strict=True)], bool)
                    begin, end = begin[goes], end[goes]
                kept = b"".join(raw[x:y] for x, y in zip([0, *end], [*begin, len(raw)], strict=True))
                out["removed"].append(len(raw) - len(kept))
                out["spans"].append(len(begin))
                out["sha"].append(hashlib.sha256(kept).hexdigest())
                out["list"].append(np.stack([begin, end], 1).tolist())
                out["kept"].append(kept.decode("utf-8", "ignore") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([False] * b.num_rows), pa.array(out["removed"], pa.int64()), pa.array(out["spans"], pa.int64()), pa.array(out["sha"]), pa.array(out["list"], pa.list_(pa.list_(pa.int64()))), pa.array(out["kept"], pa.string())],
                names=[*KEY, "whole", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    part = rows.mapInArrow(run, "k1 long, k2 long, whole boolean, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, kept string")
    size = F.octet_length("text").cast("long")
    full = texts.filter(whole).select(*KEY, F.lit(True).alias("whole"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.array(F.array(F.lit(0).cast("long"), size)).alias("spans"), F.lit("").alias("kept"))
    return saved(docs.sparkSession, part.unionByName(full), "spans")


def dedup(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, most: int = ANCHOR_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row of docs."""
    docs = docs.select("doc_id", "text")
    found = removed_spans(docs, min_bytes, gram, most=most).drop("kept", "whole").withColumnRenamed("kept_sha256", "own_sha256")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha256"), *text_key(text))
    zero = F.lit(0).cast("long")
    return rows.join(found, list(KEY), "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("own_sha256", "sha256").alias("kept_sha256"), "spans")


def dedup_texts(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, over_words: int | None = None) -> DataFrame:
    """docs with each text cut to the bytes kept; a character that loses a part goes whole.
    over_words: as in removed_spans."""
    found = removed_spans(docs.select("doc_id", "text"), min_bytes, gram, with_text=True, over_words=over_words).alias("found")
    keys = F.struct(*text_key(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), keys.alias("key")).alias("rows")
    same = (F.col("rows.key.k1") == F.col("found.k1")) & (F.col("rows.key.k2") == F.col("found.k2"))
    text = F.coalesce("found.kept", "rows.row.text").alias("text")
    return rows.join(found, same, "left").select(*(text if c == "text" else F.col("rows.row")[c].alias(c) for c in docs.columns))
