"""The graph in outline: for each document the number of its pieces and the keys it links to.

A section or statement hangs on its document and has an id that the document's id begins, so
it never is the least id of a component and adds nothing to what is connected. Components,
and counts of nodes and links, come from documents and names alone:

- `of` writes one row a document.
- `points` are the ids of documents and names. Documents are sorted by key, in whatever order
  they lie, as names that link to each other often begin alike. What a run of them connects is
  found in the worker that reads them, so that an exchange gets one row for each key of a run,
  not one for each link. A run holds a bounded number of keys, and each key but null the number of
  its connected set (`at`); keys that several runs hold join those sets.
- A document may be named as a piece of another is, as `a s0` of `a`: such ids are one node.
- Links of one document with ends alike stand in its row, so mentions are dropped there. Links are
  joined only of documents whose id another node has, or that write one target's key in two ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem, title_key
from ..sources.shared import bounded, written
from . import components, graph

#: Keys, and characters of keys, that a worker connects at once.
RUN_KEYS, RUN_CHARS = 200_000, 16 << 20
_RUN = "key string, docs int, sections int, statements int, linked boolean, at long"
_ARROW = pa.schema([("key", pa.string()), ("docs", pa.int32()), ("sections", pa.int32()), ("statements", pa.int32()), ("linked", pa.bool_()), ("at", pa.int64())])
#: Sets are numbered by the partition and their place in it.
_PART = 1 << 40


@dataclass
class Outline:
    """documents: doc_id, key, sections, statements, links. points: id, found (a document), keys,
    sections, statements, linked, nested (a piece of another document too), root (what ids of
    one component share). nested: id and the id of the document that it is a piece of. shared:
    doc_id that several documents, or a document and a piece, have."""

    documents: DataFrame
    points: DataFrame
    nested: DataFrame
    shared: DataFrame


def of(notes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written, run_keys: int = RUN_KEYS) -> Outline:
    parsed = graph.parsed(notes)
    links = F.transform("links", lambda x: F.struct(title_key(x["target"]).alias("key"), F.coalesce(x["relation"], F.lit("mentions")).alias("relation")))
    table = parsed.select("doc_id", title_key(stem(F.col("path"))).alias("key"), F.size("sections").alias("sections"), F.size("statements").alias("statements"), links.alias("links"))
    # a document without a path is a node all the same, with nothing else
    bare = graph.parse(notes.filter("rel_path is null"), graph.unwritten).documents
    rest = bare.select("doc_id", "key", F.lit(0).alias("sections"), F.lit(0).alias("statements"), F.array().cast("array<struct<key:string,relation:string>>").alias("links"))
    documents = keep(table.unionByName(rest), "outline")
    return Outline(documents, *_points(documents, keep, run_keys))


def _runs(run_keys: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = _Run(TaskContext.get().partitionId() * _PART)
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            run.add(*row)
            if len(run.keys) >= run_keys or run.chars >= RUN_CHARS:
                yield from run.rows()
                run = _Run(run.first + len(run.keys))
    yield from run.rows()


class _Run:
    """Keys of some documents in a row, as trees of what is connected."""

    def __init__(self, first: int) -> None:
        self.first = first
        self.place: dict[str | None, int] = {}
        self.keys: list[str | None] = []
        self.up: list[int] = []
        self.pieces: list[tuple[int, int, int]] = []
        self.linked = bytearray()
        self.chars = 0

    def find(self, key: str | None) -> int:
        i = self.place.get(key)
        if i is None:
            i = self.place[key] = len(self.keys)
            self.keys.append(key)
            self.up.append(i)
            self.pieces.append((0, 0, 0))
            self.linked.append(0)
            self.chars += len(key or "")
        return i

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def add(self, key: str | None, sections: int, statements: int, links: list[str]) -> None:
        i = self.find(key)
        docs, *had = self.pieces[i]
        self.pieces[i] = (docs + 1, max(had[0], sections), max(had[1], statements))
        for target in links:
            j = self.find(target)
            self.linked[i] = self.linked[j] = 1
            a, b = self.top(i), self.top(j)
            self.up[max(a, b)] = min(a, b)

    def rows(self, size: int = 10_000) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(self.keys), size):
            span = range(first, min(first + size, len(self.keys)))
            columns = [
                [self.keys[i] for i in span],
                *zip(*(self.pieces[i] for i in span), strict=True),
                [self.linked[i] == 1 for i in span],
                [None if self.keys[i] is None else self.first + self.top(i) for i in span],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def in_key_order(documents: DataFrame) -> DataFrame:
    """Keys of documents and of their links, sorted. Their places keep documents of one key from
    having to meet in one task, and make the order the same whenever a task runs again."""
    rows = bounded(documents).select("key", "sections", "statements", F.array_distinct(F.transform("links", lambda x: x["key"])).alias("links"), F.monotonically_increasing_id().alias("n"))
    return rows.repartitionByRange("key", "n").sortWithinPartitions("key", "n").drop("n")


def _points(documents: DataFrame, keep: Callable[[DataFrame, str], DataFrame], run_keys: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two keys have one id if they differ in blanks and underscores alone, and both or neither
    are a document's. Both aggregations run on one exchange, by what the ids are made of."""
    runs = in_key_order(documents).mapInArrow(partial(_runs, run_keys), _RUN)
    most = [F.max(c).alias(c) for c in ("sections", "statements", "linked")]
    by_key = runs.repartition(_tail("key")).groupBy(_tail("key").alias("tail"), "key").agg(F.sum("docs").alias("docs"), *most, F.collect_set("at").alias("at"))
    by_id = by_key.groupBy("tail", (F.col("docs") > 0).alias("found")).agg(F.count(F.lit(1)).alias("keys"), F.sum("docs").alias("docs"), *most, F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    found = keep(by_id, "points")

    first = lambda c: F.get(c, F.lit(0))
    part = lambda i: F.regexp_extract("tail", r"(?s)\A(.*)_([st])(0|[1-9][0-9]{0,8})\z", i)
    odd = keep(found.filter(F.col("found") & (part(3) != "")).select("tail", part(1).alias("of"), part(2).alias("kind"), part(3).cast("int").alias("idx"), first("at").alias("a")), "odd")
    whole = found.filter("found").select(F.col("tail").alias("of"), "sections", "statements", first("at").alias("b"))
    nested = keep(odd.join(whole, "of").filter(F.col("idx") < F.when(F.col("kind") == "s", F.col("sections")).otherwise(F.col("statements"))).select("tail", "of", "a", "b"), "nested")

    several = found.filter(F.size("at") > 1).select(first("at").alias("a"), F.explode(F.slice("at", 2, F.size("at") - 1)).alias("b"))
    joined = keep(components.labels(several.unionByName(nested.select("a", "b")), keep), "joined").withColumnRenamed("id", "first")
    doc = lambda c: F.concat(F.lit("doc_"), c)
    id_ = F.when(F.col("found"), doc(F.col("tail"))).otherwise(F.concat(F.lit("name_"), F.col("tail")))
    rows = found.withColumn("first", first("at")).join(joined, "first", "left").select(id_.alias("id"), "found", "keys", "sections", "statements", "linked", F.coalesce("label", "first").alias("root"))
    pairs = nested.select(doc(F.col("tail")).alias("id"), doc(F.col("of")).alias("of"))
    shared = found.filter(F.col("found") & (F.col("docs") > 1)).select(doc(F.col("tail")).alias("doc_id")).unionByName(pairs.select(F.col("id").alias("doc_id")))
    return rows.join(pairs.select("id", F.lit(True).alias("nested")), "id", "left").withColumn("nested", F.coalesce("nested", F.lit(False))), pairs, shared


def _tail(key: str | Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit("_"))


def distinct_nodes() -> Column:
    """Of a point: itself, unless it is counted as a piece already, and its pieces."""
    return F.lit(1) - F.col("nested").cast("long") + F.col("sections") + F.col("statements")


def kept_mentions(outline: Outline, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """One row: mentions, the number of them that no other link of their ends suppresses."""
    keys = F.transform("links", lambda x: x["key"])
    forked = F.size(F.array_distinct(keys)) > F.size(F.array_distinct(F.transform(keys, _tail)))
    rows = outline.documents.select("doc_id", "links", forked.alias("forked"))
    shared = keep(outline.shared.distinct(), "shared")
    asked, inside = rows.filter("forked"), rows.filter("not forked")
    if not shared.isEmpty():
        asked = asked.unionByName(inside.join(shared, "doc_id", "left_semi"))
        inside = inside.join(shared, "doc_id", "left_anti")
    named = keep(asked.select(F.col("doc_id").alias("source"), F.explode("links").alias("x")).select("source", "x.*"), "asked")
    counts = inside.select(_lone_mentions().alias("n"))
    if not named.isEmpty():
        counts = counts.unionByName(_lone_pairs(outline, named))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))


def _lone_mentions() -> Column:
    """Of a document's links: mentions whose key no other relation has. Sorted, so that a key's
    other relations come before its mentions, and a long array is gone through once."""
    plain = lambda x: x["relation"] == "mentions"
    ends = F.array_sort(F.transform("links", lambda x: F.struct(x["key"].alias("key"), plain(x).alias("plain"))))
    start = F.struct(F.lit(None).cast("string").alias("other"), F.lit(0).cast("long").alias("n"))
    lone = lambda acc, x: x["plain"] & ~F.coalesce(x["key"] == acc["other"], F.lit(False))
    step = lambda acc, x: F.struct(F.when(x["plain"], acc["other"]).otherwise(x["key"]).alias("other"), (acc["n"] + lone(acc, x).cast("long")).alias("n"))
    return F.aggregate(ends, start, step, lambda acc: acc["n"])


def _lone_pairs(outline: Outline, named: DataFrame) -> DataFrame:
    """n, the mentions of a source and target that nothing else links. named: source, key, relation."""
    found = outline.documents.join(named.select("key").distinct(), "key", "left_semi")
    ends = named.join(graph.key_dictionary(found), "key", "left").withColumn("target", F.coalesce("to_id", graph.name_id(F.col("key"))))
    plain = F.col("relation") == "mentions"
    pairs = ends.groupBy("source", "target").agg(F.count_if(plain).alias("n"), F.count_if(~plain).alias("other"))
    part = outline.nested.select(F.col("id").alias("source"), F.col("of").alias("target"))
    return pairs.filter("n > 0 and other = 0").join(part, ["source", "target"], "left_anti").select("n")
