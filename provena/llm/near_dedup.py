"""Near duplicates by min-max hashing.

A document is the set of its shingles of `width` words (A-Z folded; fewer words are a set of
one, all of them; no words: the empty set, linked with nothing). Each of `permutations` hash
functions gives two signature values, the smallest and the largest hash of the set:
half the evaluations of plain minwise hashing for as many values, of lower variance.
Bands of `rows` values are bucket keys; with 40 bands of 6 values a pair of similarity
0.8 shares no bucket with odds of 5e-6, and less above.

Links are confirmed on full sets. Within buckets the number of comparisons stays linear
without dropping any: first each document is compared with the least leader of its buckets;
then, per bucket, the leaders of different components. What still meets in buckets without
being connected goes through a prefix filter: of two sets of similarity 0.8 the rarest fifth
of each holds a common shingle, whatever order decides what is rare, so documents that share
none with another component cannot link. The rest is compared in blocks (see rest). Pairs
already connected add nothing to components.

Equal texts are one node. Rows with equal ids are one document. Of rows without an id each
text is a document of its own, after all others; its component_id is null where no document
with an id is in the component, and then the one first by text key is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import labels
from .common import chunks, runs, saved, session
from .repeats import KEY, distinct_texts, text_key
from .textkit import U64, Words, mix, prefix_sums, rolling, span_hash

WIDTH, PERMUTATIONS, ROWS, PERCENT = 5, 120, 6, 80
#: Slots of the table that tells rare shingles from common ones, a few bytes each.
SLOT_BITS, BLOCK_BITS = 20, 13
#: Bytes of text in a block of the last comparison.
BLOCK_BYTES = 2 << 20
#: What distinct_texts has for a null id, and the first of the numbers that stand for such texts here.
_MAX, _NONE = (1 << 63) - 1, 3 << 61


def shingles(texts: list[str | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, each text's sorted, and the text bounds."""
    words = Words(texts, lower=True)
    first, n = words.first[:-1], words.counts
    fits = np.maximum(n - width + 1, 0)
    few = np.flatnonzero((n > 0) & (n < width))
    value = np.append(rolling(words.hash, width)[runs(first, fits)] if fits.any() else np.empty(0, U64), span_hash(prefix_sums(words.hash), first[few], first[few] + n[few]) if len(few) else np.empty(0, U64))
    owner = np.append(np.repeat(np.arange(len(n)), fits), few)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def band_keys(values: np.ndarray, bounds: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """Bucket keys (texts x bands) of the sets that aren't empty."""
    odd = np.random.default_rng(8191).integers(1, 1 << 63, (permutations, 2), dtype=np.uint64) | U64(1)
    full = np.flatnonzero(np.diff(bounds))
    signature = np.empty((2 * permutations, len(full)), U64)
    at = bounds[:-1][full]
    for i, (a, b) in enumerate(odd):
        h = values * a
        h ^= h >> U64(32)
        h *= b
        np.minimum.reduceat(h, at, out=signature[2 * i])
        np.maximum.reduceat(h, at, out=signature[2 * i + 1])
    bands = 2 * permutations // rows
    key = np.zeros((bands, len(full)), U64)
    for r in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + signature[r : bands * rows : rows])
    return mix(key + np.arange(1, bands + 1, dtype=U64)[:, None] * U64(0xC2B2AE3D27D4EB4F)).T


def signatures(texts: DataFrame, width: int = WIDTH, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """k1, k2, first_id, n_shingles and bands (empty for an empty set) of distinct texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            values, bounds = shingles(b.column(3).to_pylist(), width)
            n = np.diff(bounds)
            keys = band_keys(values, bounds, permutations, rows) if n.any() else np.empty((0, 1), U64)
            offsets = np.append(0, np.cumsum((n > 0) * keys.shape[1]))
            bands = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(keys).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n.astype(np.int64)), bands], names=[*KEY, "first_id", "n_shingles", "bands"])

    return texts.select(*KEY, "first_id", "text").mapInArrow(run, "k1 long, k2 long, first_id long, n_shingles long, bands array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have 100 * intersection >= percent * union."""
    rows = pairs.join(texts.select(F.col("first_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("first_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "ta"):
            n = b.num_rows
            values, bounds = shingles(b.column(2).to_pylist() + b.column(3).to_pylist(), width)
            size = np.diff(bounds)
            owner = np.repeat(np.append(np.arange(n), np.arange(n)), size)
            order = np.lexsort((values, owner))
            v, o = values[order], owner[order]
            both = np.bincount(o[1:][(v[1:] == v[:-1]) & (o[1:] == o[:-1])], minlength=n)
            union = size[:n] + size[n:] - both
            keep = pa.array((100 * both >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each one reaches."""
    spark = session(edges)
    return labels(edges, lambda df, label: saved(spark, df, label)).withColumnRenamed("id", "node")


def links(texts: DataFrame, marks: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """a, b (a < b): confirmed links that connect all near duplicates among the texts."""
    spark = session(texts)
    rows = marks.select("first_id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("first_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # written first, as other sides of joins on buckets below: a join that shares its stage with an
    # aggregation is not split where a bucket is large
    shared = saved(spark, shared, "shared")
    members = saved(spark, rows.join(shared, "bucket"), "buckets")
    nodes = members.select("first_id").distinct()
    wanted = marks.select(*KEY, "first_id").join(nodes, "first_id", "left_semi").select(*KEY)
    chosen = saved(spark, texts.join(wanted, list(KEY)).select("first_id", "text"), "candidates")
    pairs = members.filter("leader < first_id").groupBy(F.col("first_id").alias("b")).agg(F.min("leader").alias("a"))
    tried = saved(spark, pairs.select("a", "b"), "tried")
    found = saved(spark, confirmed(tried, chosen, width, percent), "links")

    def apart(found: DataFrame) -> DataFrame:
        """Members, with labels, of the buckets that hold more than one component."""
        own = members.join(components(found).withColumnRenamed("node", "first_id"), "first_id", "left").select("bucket", "first_id", F.coalesce("label", "first_id").alias("label"))
        own = saved(spark, own, "labelled")
        mixed = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
        mixed = saved(spark, mixed, "mixed")
        return saved(spark, own.join(mixed, "bucket"), "apart")

    own = apart(found)
    if own.isEmpty():
        return found
    heads = own.groupBy("bucket", "label").agg(F.min("first_id").alias("b"))
    least = heads.groupBy("bucket").agg(F.min("b").alias("a"))
    pairs = heads.join(least, "bucket").filter("a < b").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    tried = saved(spark, tried.unionByName(pairs), "tried")
    found = saved(spark, found.unionByName(confirmed(tried.join(found, ["a", "b"], "left_anti"), chosen, width, percent)), "links")

    own = apart(found)
    return found if own.isEmpty() else saved(spark, found.unionByName(rest(own, chosen, width, percent)), "links")


def in_play(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Of rows (grp, label, first_id, text) those that may link with another label of their group,
    in finer groups: labels of one group that share a shingle among the rarest that a link must
    have one of. How rare a shingle is comes from a table of 2 ** SLOT_BITS counts; any order
    that is the same for all documents makes the filter exact."""
    spark = session(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in chunks(batches):
            values, _ = shingles(b.column(0).to_pylist(), width)
            total += np.bincount((values >> U64(64 - SLOT_BITS)).astype(np.int64), minlength=len(total))
        slot = np.flatnonzero(total)
        yield pa.record_batch({"slot": slot.astype(np.int32), "n": total[slot]})

    def block(part: pa.Table) -> pa.Table:
        own = np.zeros(1 << BLOCK_BITS, np.int64)
        np.add.at(own, part.column("slot").to_numpy() & ((1 << BLOCK_BITS) - 1), part.column("n").to_numpy())
        return pa.table({"block": part.column("block")[:1], "counts": pa.array([np.minimum(own, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    # packed by executors, so that the driver gets a few megabytes in a few rows
    counts = rows.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).withColumn("block", F.shiftright("slot", BLOCK_BITS))
    common = np.zeros((1 << (SLOT_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint32)
    for at, data in counts.groupBy("block").applyInArrow(block, "block int, counts binary").toLocalIterator():
        common[at] = np.frombuffer(data, np.uint32)
    common = common.ravel()
    shared = spark.sparkContext.broadcast(common)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            values, bounds = shingles(b.column(3).to_pylist(), width)
            size = np.diff(bounds)
            owner = np.repeat(np.arange(b.num_rows), size)
            group = mix(b.column(0).to_numpy().astype(U64))
            order = np.lexsort((values, shared.value[(values >> U64(64 - SLOT_BITS)).astype(np.int64)], owner))
            # a link has an intersection of percent of either set at least
            prefix = np.where(size > 0, size - -(-size * percent // 100) + 1, 0)
            at = order[runs(bounds[:-1], prefix)]
            take = pa.array(owner[at])
            token = mix(values[at] ^ group[owner[at]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), b.column(1).take(take), b.column(2).take(take)], names=["token", "first_id", "label"])

    tokens = saved(spark, rows.select("grp", "first_id", "label", "text").mapInArrow(rare, "token long, first_id long, label long"), "rare")
    mixed = tokens.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a < z").drop("z")
    met = saved(spark, tokens.join(mixed, "token").select("first_id", "label", "a").distinct(), "met")
    groups = components(met.filter("a < label").select("a", F.col("label").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("grp"))
    return rows.drop("grp").join(met.select("first_id").distinct(), "first_id").join(groups, "label").select("grp", "label", "first_id", "text")


def rest(own: DataFrame, chosen: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members (first_id, label) of buckets that hold several components.

    Components that meet in a bucket form a group. What the prefix filter leaves of it goes to
    blocks of bounded size, and every two blocks of a group meet once; small groups share a block of their own. Inside, posting lists count
    the intersections of the texts outside a group's largest component with all others of a
    size that can link: only links come out, not the pairs compared.
    """
    spark = session(own)
    least = own.groupBy("bucket").agg(F.min("label").alias("a"))
    meet = own.join(least, "bucket").filter("a < label").select("a", F.col("label").alias("b")).distinct()
    groups = components(meet).select(F.col("node").alias("label"), F.col("label").alias("grp"))
    rows = own.select("first_id", "label").distinct().join(groups, "label").join(chosen, "first_id")
    rows = saved(spark, rows.select("grp", "label", "first_id", "text"), "unconnected")
    rows = saved(spark, in_play(rows, width, percent), "rest")
    sizes = rows.groupBy("grp").agg(F.sum(F.octet_length("text") + 64).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    sizes = sizes.select("grp", F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("first_id"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, "grp").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    small = F.col("blocks") == 1
    shelf = F.pmod(F.xxhash64("grp"), F.lit(max(1, total // BLOCK_BYTES)))
    dealt = dealt.select(F.when(small, -1).otherwise(F.col("grp")).alias("set"), F.when(small, shelf).otherwise(F.least("mine", "other")).alias("i"), F.when(small, -1).otherwise(F.greatest("mine", "other")).alias("j"), "grp", "label", "first_id", "text")
    return dealt.groupBy("set", "i", "j").applyInArrow(_compare(width, percent), "a long, b long")


def _compare(width: int, percent: int):
    def run(part: pa.Table) -> pa.Table:
        grp, label, node = (part.column(c).to_numpy() for c in ("grp", "label", "first_id"))
        values, bounds = shingles(part.column("text").to_pylist(), width)
        size = np.diff(bounds)
        owner = np.repeat(np.arange(len(grp)), size)
        values = mix(values + grp[owner].astype(U64) * U64(0x9E3779B97F4A7C15))
        by = np.argsort(values, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(values[by]) != 0)) if len(by) else by
        posting, length = owner[by], np.diff(np.append(head, len(by)))
        slot = np.empty(len(by), np.int64)
        slot[by] = np.repeat(np.arange(len(head)), length)
        pairs, times = np.unique(np.stack([grp, label]), axis=1, return_counts=True)
        most: dict[int, tuple[int, int]] = {}
        for g, l, n in zip(*pairs.tolist(), times.tolist(), strict=True):
            most[g] = max(most.get(g, (0, 0)), (n, l))
        major = np.array([most[g][1] for g in grp.tolist()]) == label
        root = {x: x for x in set(label.tolist())}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for x in np.flatnonzero(~major & (size > 0)):
            slots = slot[bounds[x] : bounds[x + 1]]
            both = np.bincount(posting[runs(head[slots], length[slots])], minlength=len(grp))
            near = (100 * both >= percent * (size + size[x] - both)) & (both > 0) & (label != label[x])
            for y in np.flatnonzero(near):
                p, q = find(int(label[x])), find(int(label[y]))
                if p != q:
                    root[p] = q
                    a.append(min(int(node[x]), int(node[y])))
                    b.append(max(int(node[x]), int(node[y])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS, with_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text); with_keys also
    the two longs of its text key, which tell rows of one id or of none apart."""
    spark = session(docs)
    docs = docs.select("doc_id", "text")
    nameless = F.lit(_NONE) + F.col("k1").bitwiseAND(F.lit((1 << 61) - 1))
    texts = distinct_texts(docs).withColumn("first_id", F.when(F.col("first_id") == _MAX, nameless).otherwise(F.col("first_id")))
    marks = saved(spark, signatures(texts, width, permutations, rows), "signatures")
    found = components(links(texts, marks, width, percent)).withColumnRenamed("node", "first_id")
    found = marks.select(*KEY, "first_id", "n_shingles").join(found, "first_id", "left").select(*KEY, "n_shingles", "first_id", F.coalesce("label", "first_id").alias("label"))
    out = docs.select("doc_id", *text_key(F.coalesce("text", F.lit("")))).join(found, list(KEY), "left")
    own = F.col("doc_id").cast("long")
    component = F.when(F.col("n_shingles") == 0, own).when(F.col("label") < _NONE, F.col("label"))
    kept = F.when(own.isNull() & (F.col("n_shingles") > 0), (F.col("first_id") == F.col("label")) & (F.col("label") >= _NONE)).otherwise(own.eqNullSafe(component))
    return out.select("doc_id", *(KEY if with_keys else ()), "n_shingles", component.alias("component_id"), kept.alias("kept"))
