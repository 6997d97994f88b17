"""Exact search for strings that occur more than once, as tables.

Each distinct text is kept once, with its number of copies and its smallest id, in a
table bucketed by text key. Every possible start of a string of the wanted length is
owned by an anchor: the leftmost of the smallest grams inside that string. Equal
strings have equal anchors at equal distances, so runs of starts with one anchor
(here: pieces) need only be compared with pieces of the same anchor. Pieces of equal
content form a class, compared through one member; so copies and near copies are
aggregated before anything wide moves. Anchors are narrow rows, counted with map-side
combination and joined (a join that Spark can split). The classes of one anchor are
judged together, in a shard; where they would be too many for one, they are cut anew by
anchors of twice the length, down to anchors as long as the string itself: then an anchor
has one class. So every class is judged by the same method in a shard of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, runs, saved, session, shared_dir, trim
from .packing import pack as _pack
from .packing import unpack as _unpack
from .textkit import Words, anchors, byte_values, mix, prefix_sums, span_hash

KEY = ("k1", "k2")


def text_key(text: Column) -> list[Column]:
    """Two longs of the text's SHA-256."""
    raw = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(raw, 1 + 16 * i, 16), 16, -10).cast("long").alias(k) for i, k in enumerate(KEY)]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """k1, k2, text, copies, first_id of every distinct text of docs (doc_id, text), null as
    empty. Bucketed and sorted by key in the shared folder: later joins by key don't move texts."""
    spark = session(docs)
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*text_key(text), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"))
    found = found.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    name = f"provena_texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.option("path", shared_dir(spark, "texts")).option("compression", "zstd").bucketBy(parts, *KEY).sortBy(*KEY).saveAsTable(name)
    del found
    release(spark)
    out = spark.table(name)
    # the files stay, and so does the bucketing that the resolved table knows; its name goes
    spark.sql(f"drop table {name}")
    return out


def symbols(texts: list[str | None], unit: str):
    """Hashable values of all symbols, each text's first symbol and number of symbols."""
    words = Words(texts)
    if unit == "words":
        return words.hash, words.first[:-1], words.counts
    return byte_values(words.data), words.text_at[:-1], np.diff(words.text_at) - 1


#: Symbols of a text whose anchors are sought at once.
SLICE = 1 << 18


def sliced(texts: list[str | None], unit: str, length: int):
    """Runs of about SLICE symbols: values, each text's first symbol and number of symbols, its
    number and the place of that first symbol in it. Slices of a text overlap by length - 1
    symbols, so every string of the length lies in one of them whole; where a run of starts
    is cut so, its two pieces have one anchor still."""
    if unit == "words":
        words = Words(texts)
        values, starts, lengths = words.hash, words.first[:-1], words.counts
    else:
        words = Words(texts, spans=False)
        values, starts, lengths = words.data, words.text_at[:-1], np.diff(words.text_at) - 1
    parts = np.maximum(1, -(-(lengths - length + 1) // SLICE))
    text = np.repeat(np.arange(len(starts)), parts)
    at = SLICE * runs(np.zeros(len(starts), np.int64), parts)
    begin, n = starts[text] + at, np.minimum(lengths[text] - at, SLICE + length - 1)
    group = np.append(0, np.cumsum(n)[:-1]) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(text)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if z > a:
            low, high = begin[a], (begin + n)[a:z].max()
            own = values[low:high]
            yield (own if unit == "words" else byte_values(own)), begin[a:z] - low, n[a:z], text[a:z], at[a:z]


#: Pieces that a task gathers before it sends them, and bytes of text to a bucket of anchors.
FLUSH, BUCKET_BYTES = 1 << 18, 8 << 20
COLUMNS = ("h", "g", *KEY, "first_id", "at", "n")


def _columns(rows: list[np.ndarray], pick: np.ndarray) -> bytes:
    return _pack([rows[0][pick].view(np.uint64), *(r[pick] for r in rows[1:])])


def find_pieces(texts: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """h (anchor), g (content), k1, k2, first_id, at, n of the pieces whose anchor is found
    twice or more: n starts from `at` on, so n + length - 1 symbols.

    Tasks send packed columns, sorted by anchor, to buckets of anchors. An anchor that a task
    meets twice is known to repeat: its pieces pass through salted buckets and only a mark
    goes to the anchor's own, which so gets one row for each task at most.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))

    def bucket(x: np.ndarray) -> np.ndarray:
        # mixed once more: anchors are the smallest of many hashes, so their leading bits are low
        return (mix(x.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)

    def send(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(rows[0].view(np.uint64), kind="stable")
        rows = [r[order] for r in rows]
        head = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
        times = np.diff(np.append(head, len(order)))
        once = np.repeat(times == 1, times)
        out: dict[int, list[bytes]] = {}

        def put(slot: int, which: np.ndarray, to: np.ndarray, columns: list[np.ndarray]) -> None:
            by = np.argsort(to, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
                out.setdefault(int(to[part[0]]), [b""] * 3)[slot] = _columns(columns, which[part])

        single, many, mark = np.flatnonzero(once), np.flatnonzero(~once), head[times > 1]
        put(0, single, bucket(rows[0][single]), rows)
        put(1, many, bucket(rows[0][many] ^ rows[2][many]), rows)
        put(2, mark, bucket(rows[0][mark]), rows[:1])
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), *(pa.array([v[i] for v in out.values()], pa.binary()) for i in range(3))], names=["bucket", "single", "many", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for b in chunks(batches):
            for values, starts, lengths, texts, offset in sliced(b.column(3).to_pylist(), unit, length):
                part, at, n, _, h = anchors(values, starts, lengths, length, gram)
                if len(part):
                    begin = starts[part] + at
                    g = span_hash(prefix_sums(values), begin, begin + n + length - 1)
                    own = [b.column(i).to_numpy()[texts[part]] for i in range(3)]
                    held.append([h.view(np.int64), g.view(np.int64), *own, (offset[part] + at).astype(np.int32), n.astype(np.int32)])
                    have += len(part)
                if have > FLUSH:
                    yield send(held)
                    held, have = [], 0
        if held:
            yield send(held)

    def meet(part: pa.Table) -> pa.Table:
        kinds = [np.uint64] + [np.int64] * 4 + [np.int32] * 2
        read = lambda name, kinds: [_unpack(x, kinds) for x in part.column(name).to_pylist() if x]
        single, many, mark = read("single", kinds), read("many", kinds), read("mark", kinds[:1])
        if single:
            rows = [np.concatenate(x) for x in zip(*single, strict=True)]
            marked = np.concatenate([m[0] for m in mark]) if mark else np.empty(0, np.uint64)
            _, back, times = np.unique(np.concatenate([rows[0], marked, marked]), return_inverse=True, return_counts=True)
            again = times[back[: len(rows[0])]] > 1
            many.append([r[again] for r in rows])
        rows = [np.concatenate(x) for x in zip(*many, strict=True)] if many else [np.empty(0, k) for k in kinds]
        trim()
        return pa.table({c: r.view(np.int64) if i == 0 else r for i, (c, r) in enumerate(zip(COLUMNS, rows, strict=True))})

    sent = texts.select(*KEY, "first_id", "text").mapInArrow(run, "bucket int, single binary, many binary, mark binary")
    rows = sent.groupBy("bucket").applyInArrow(meet, "h long, g long, k1 long, k2 long, first_id long, at int, n int")
    return saved(texts.sparkSession, rows, f"pieces-{unit}")


PIECE = ("first_id", *KEY, "at")


def classes(pieces: DataFrame, length: int) -> DataFrame:
    """One row for each class of equal pieces of anchors found twice or more: its size, its
    earliest piece (by id, key and place), its symbols, and the anchor's number of classes."""
    spark = pieces.sparkSession
    first = F.min(F.struct(*PIECE)).alias("first")
    # both sides of the join are written: Spark splits a skewed join only where no aggregation shares its stage
    own = saved(spark, pieces.groupBy("h", "g").agg(F.sum("size").alias("size"), first, F.first("n").alias("n")), "classes")
    anchor = own.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.sum("size").alias("pieces"), F.sum(F.col("n") + (length - 1)).alias("symbols")).filter("pieces > 1")
    anchor = saved(spark, anchor.drop("pieces"), "anchors")
    return saved(spark, own.join(anchor, "h").select("h", "g", "size", "first.*", "n", "classes", "symbols"), "classes")


def judged(pieces: DataFrame, texts: DataFrame, unit: str, length: int, gram: int, most: int, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs of starts that recur, for the classes of pieces: h, g, off, len, and, if judge gives
    them, not_first (whether that of the class's earliest piece goes too) and that piece, first.

    judge makes those rows of a table of classes whose anchors have up to `most` symbols each.
    The classes of larger anchors are pieces of anchors of a longer gram, of which each stands
    for as many as its class has; what is found for them is put back in their classes."""
    pieces = pieces if "size" in pieces.columns else pieces.withColumn("size", F.lit(1).cast("long"))
    found = classes(pieces, length)
    out = judge(found.filter(F.col("symbols") <= most) if gram < length else found)
    crowded = found.filter(F.col("symbols") > most)
    if gram >= length or crowded.isEmpty():
        return out
    longer = min(length, 2 * gram)
    parts = saved(texts.sparkSession, split_pieces(cut_pieces(crowded, texts, unit, length), unit, length, longer), f"split-{longer}")
    below = judged(parts, texts, unit, length, longer, most, judge)
    rows = parts.join(below, ["h", "g"])
    back = [F.col("from_h").alias("h"), F.col("from_g").alias("g"), (F.col("from_off") + F.col("off")).alias("off"), "len"]
    if "first" in below.columns:
        back.append((F.col("not_first") | (F.struct(*PIECE) != F.col("first"))).alias("not_first"))
        back.append(F.struct("first_id", *KEY, (F.col("at") - F.col("from_off")).alias("at")).alias("first"))
    return out.unionByName(rows.select(*back))


def split_pieces(cut: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """The pieces by longer grams of pieces that are cut out: h (of both anchors), g, size,
    first_id, k1, k2, at, n, and from_h, from_g, from_off, what they were part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "data"):
            values, starts, lengths = symbols(b.column(8).to_pylist(), unit)
            piece, off, n, _, h = anchors(values, starts, lengths, length, gram)
            begin = starts[piece] + off
            g = span_hash(prefix_sums(values), begin, begin + n + length - 1) if len(piece) else np.empty(0, np.uint64)
            old = b.column(0).to_numpy()[piece]
            take = pa.array(piece)
            own = [b.column(i).take(take) for i in (2, 3, 4, 5)]
            at = pa.array((b.column(6).to_numpy()[piece] + off).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(h ^ mix(old.view(np.uint64))).view(np.int64)), pa.array(g.view(np.int64)), *own, at, pa.array(n.astype(np.int32)), pa.array(old), b.column(1).take(take), pa.array(off.astype(np.int32))],
                names=["h", "g", "size", *PIECE, "n", "from_h", "from_g", "from_off"],
            )

    return cut.mapInArrow(run, "h long, g long, size long, first_id long, k1 long, k2 long, at int, n int, from_h long, from_g long, from_off int")


def shards(found: DataFrame, texts: DataFrame, unit: str, length: int, size: int) -> DataFrame:
    """The classes with their content and the shard they belong to: all classes of an anchor are
    in one shard, and shards have about `size` bytes."""
    cut = saved(texts.sparkSession, cut_pieces(found, texts, unit, length), "cut")
    total = cut.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    return cut.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(max(1, -(-total // size)))))


def cut_pieces(found: DataFrame, texts: DataFrame, unit: str, length: int) -> DataFrame:
    """The content of the earliest piece of each class: h, g, size, first_id, k1, k2, at, n, data.
    Byte pieces are bytes, word pieces the bytes from their first word to their last."""
    by_text = found.groupBy(*KEY).agg(F.collect_list(F.struct("h", "g", "size", "first_id", "at", "n")).alias("wanted"))
    rows = by_text.join(texts.select(*KEY, "text"), list(KEY)).select(*KEY, "wanted", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            wanted = b.column(2)
            flat, owner = wanted.flatten(), np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
            at, n = (flat.field(i).to_numpy() for i in (4, 5))
            begin, end = at.astype(np.int64), at.astype(np.int64) + n + length - 1
            words = Words(b.column(3).to_pylist(), spans=unit == "words")
            if unit == "words":
                begin, end = words.start[words.first[owner] + begin], words.end[words.first[owner] + end - 1]
            else:
                begin, end = words.text_at[owner] + begin, words.text_at[owner] + end
            data = [words.data[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [flat.field(0), flat.field(1), flat.field(2), flat.field(3), b.column(0).take(take), b.column(1).take(take), flat.field(4), flat.field(5), pa.array(data, pa.binary())],
                names=["h", "g", "size", "first_id", *KEY, "at", "n", "data"],
            )

    return rows.mapInArrow(run, "h long, g long, size long, first_id long, k1 long, k2 long, at int, n int, data binary")


def covered(starts: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [s, s + n + length - 1) over runs of removed starts: begins and ends."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], (starts + n + length - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return begin[head], np.append(reach[head[1:] - 1], reach[-1])
