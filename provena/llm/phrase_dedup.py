"""Repeated phrases located with sharded Aho-Corasick automata.

Documents are streamed in pieces (see repeats), equal pieces once. A piece whose anchor
occurs once in all documents cannot hold a recurring window; all others go to a shard of
bounded size by their anchor. A shard confirms the word windows that recur - in two places
of its pieces, or in a piece that stands for several - compiles them into an automaton
(words are numbered, a window is a string of numbers), and streams every one of its pieces
through it, which locates each occurrence. What is removed is what the automata locate,
but for the earliest occurrence of each window. All occurrences of a window have one
anchor, so they all pass through the automaton that holds it, and each document's words
pass through those automata alone that can match there - not through every shard.

Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged; null has none. A word is
removed if a window of `window` words over it also starts earlier: in a document of
smaller id, or earlier in the same one. Rows of equal id and text are one document; of
texts with equal ids the smaller SHA-256 goes first; null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, runs, saved, trim
from .repeats import KEY, PIECE, covered, distinct_texts, find_pieces, judged, shards, text_key
from .textkit import Words, rolling

WINDOW, GRAM = 20, 4
#: Bytes of a shard, and words of one anchor's classes beyond which they are split by a longer gram.
SHARD_BYTES, ANCHOR_WORDS = 1 << 17, 20_000
#: Words joined at once for a digest.
JOIN_WORDS = 1 << 16


def as_string(ids: np.ndarray) -> str:
    """Numbers as code points, past the control characters and the surrogates."""
    points = ids.astype(np.uint32) + np.uint32(32)
    points += np.where(points >= 0xD800, np.uint32(0x800), np.uint32(0))
    return points.astype("<u4").tobytes().decode("utf-32-le")


def recurring(pieces: list[bytes], twice: np.ndarray, window: int) -> tuple[Words, np.ndarray]:
    """The words of the pieces, and a start word of each window that recurs in them or stands in
    a piece that does."""
    words = Words(pieces)
    fits = np.maximum(words.counts - window + 1, 0)
    starts = runs(words.first[:-1], fits)
    if not len(starts):
        return words, starts
    _, head, back, times = np.unique(rolling(words.hash, window)[starts], return_index=True, return_inverse=True, return_counts=True)
    again = times > 1
    again[back[np.repeat(twice, fits)]] = True
    return words, np.sort(starts[head[again]])


def occurrences(words: Words, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, start word and number of every occurrence of the windows at starts, as one automaton
    of all of them locates them in the pieces."""
    _, ids = np.unique(words.hash, return_inverse=True)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    text = as_string(ids)
    for number, at in enumerate(starts.tolist()):
        automaton.add_word(text[at : at + window], number)
    if not len(automaton):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    automaton.make_automaton()
    # pieces are joined without a divider: what is found across a border is dropped below
    found = np.fromiter((x for pair in automaton.iter(text) for x in pair), np.int64).reshape(-1, 2)
    at = found[:, 0] - (window - 1)
    piece = np.searchsorted(words.first, at, "right") - 1
    inside = at + window <= words.first[piece + 1]
    return piece[inside], (at - words.first[piece])[inside], found[inside, 1]


def _shard(window: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        twice = part.column("size").to_numpy() > 1
        piece, off, number = occurrences(*recurring(part.column("data").to_pylist(), twice, window), window)
        first_id, k1, k2, at = (part.column(c).to_numpy()[piece] for c in PIECE)
        order = np.lexsort((at + off, k2, k1, first_id, number))
        later = np.zeros(len(order), bool)
        later[order[1:]] = number[order[1:]] == number[order[:-1]]
        # of a window's earliest place only the other pieces of that class go
        gone = np.flatnonzero(later | twice[piece])
        gone = gone[np.lexsort((off[gone], piece[gone]))]
        p, o, later = piece[gone], off[gone], later[gone]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1) | (later[1:] != later[:-1])
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(p)))
        take = pa.array(p[head])
        trim()
        return pa.table({"h": part.column("h").take(take), "g": part.column("g").take(take), "off": pa.array(o[head].astype(np.int32)), "len": pa.array(n.astype(np.int32)), "not_first": pa.array(later[head]), "first": pa.StructArray.from_arrays([part.column(c).take(take).combine_chunks() for c in PIECE], names=list(PIECE))})

    return run


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = ANCHOR_WORDS) -> DataFrame:
    """k1, k2, at, n: runs of windows, in distinct texts, that also start earlier."""

    def judge(found: DataFrame) -> DataFrame:
        rows = shards(found, texts, "words", window, SHARD_BYTES).select("shard", "h", "g", "size", *PIECE, "data")
        rows = rows.groupBy("shard").applyInArrow(_shard(window), "h long, g long, off int, len int, not_first boolean, first struct<first_id:long,k1:long,k2:long,at:int>")
        return saved(texts.sparkSession, rows, "judged")

    gram = min(gram, window)
    pieces = find_pieces(texts, "words", window, gram)
    found = judged(pieces, texts, "words", window, gram, most, judge)
    rows = pieces.join(found, ["h", "g"]).filter(F.col("not_first") | (F.struct(*PIECE) != F.col("first")))
    return rows.select(*KEY, (F.col("at") + F.col("off")).alias("at"), F.col("len").alias("n"))


def dedup_by_text(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = ANCHOR_WORDS) -> DataFrame:
    """k1, k2, first_id, n_words, n_removed, kept_sha256 and spans of each distinct text."""
    texts = distinct_texts(docs)
    found = repeats(texts, window, gram, most).groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    rows = texts.join(found, list(KEY), "left").select(*KEY, "first_id", "starts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            sizes, removed, shas, spans = [], [], [], []
            words = Words(b.column(4).to_pylist())
            for i, starts in enumerate(b.column(3).to_pylist()):
                first, last = words.first[i], words.first[i + 1]
                sizes.append(last - first)
                begin, end = np.empty(0, np.int64), np.empty(0, np.int64)
                if starts:
                    begin, end = covered(np.array([s["at"] for s in starts]), np.array([s["n"] for s in starts]), window)
                removed.append((end - begin).sum())
                spans.append(np.stack([begin, end], 1).tolist())
                sha, gap = hashlib.sha256(), b""
                for x, y in zip(first + np.append(0, end), np.append(first + begin, last), strict=True):
                    for a in range(x, y, JOIN_WORDS):
                        part = words.data[words.start[a] : words.end[min(y, a + JOIN_WORDS) - 1]].tobytes()
                        sha.update(gap + b" ".join(part.split()))
                        gap = b" "
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                names=[*KEY, "first_id", "n_words", "n_removed", "own_sha256", "spans"],
            )

    out = rows.mapInArrow(run, "k1 long, k2 long, first_id long, n_words long, n_removed long, own_sha256 string, spans array<array<bigint>>")
    return saved(docs.sparkSession, out, "phrases")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (of words) of every row of docs."""
    docs = docs.select("doc_id", "text")
    found = dedup_by_text(docs, window, gram, most)
    rows = docs.select("doc_id", *text_key(F.coalesce("text", F.lit("")))).join(found, list(KEY), "left")
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) > F.col("first_id")) & (F.col("n_words") >= window)
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("own_sha256")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
    )
