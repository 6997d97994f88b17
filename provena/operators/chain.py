"""Lookup by name, and chains of relations as unrolled frontier joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import CAUSE_RELATIONS, CHAIN_DEPTH, CHAIN_ROWS, NEARBY_RELATIONS
from ..sources.shared import written
from .graph import last_by_id

#: Walks: whether they follow links forward, and the relations they follow.
WALKS = {"came_from": (True, CAUSE_RELATIONS), "led_to": (False, CAUSE_RELATIONS), "nearby": (True, NEARBY_RELATIONS)}


def find_node(nodes: DataFrame, wanted: str) -> DataFrame:
    """The first node with exactly this label (letter case and outer space aside), else the
    shortest label that holds it; at most one row."""
    name = F.lower(F.lit(wanted.strip()))
    label = F.lower(strip(F.col("label")))
    rank = F.when(label == name, 0).when(F.contains(label, name), 1)
    length = F.when(rank == 1, F.length("label")).otherwise(0)
    return nodes.withColumn("r", rank).withColumn("n", length).filter("r is not null").orderBy("r", "n", "id", "ins").limit(1).drop("r", "n", "ins")


def edge_order(source: Column, target: Column, relation: Column) -> Column:
    return F.struct(source.alias("s"), target.alias("t"), relation.alias("r"))


def expand(front: DataFrame, seen: DataFrame, edges: DataFrame) -> DataFrame:
    """Next level of a breadth-first walk, written out: every later level reads it twice.

    front and seen: start, id, rank; edges: id, next,
    relation, e. The first to reach a node, in visiting order, gives its relation and rank."""
    step = front.select("start", "id", "rank").join(edges, "id").select("start", F.col("next").alias("id"), "relation", F.concat("rank", F.array("e")).alias("rank"))
    best = step.groupBy("start", "id").agg(F.min(F.struct("rank", "relation")).alias("b")).select("start", "id", "b.relation", "b.rank")
    return written(best.join(seen.select("start", "id"), ["start", "id"], "left_anti"), "level")


def steps(links: DataFrame, walks: tuple[str, ...] = tuple(WALKS)) -> DataFrame:
    """direction, id, next and relation of each step that these walks can take. Written out is
    one row for two nodes and the relations of a walk."""
    sets = list(dict.fromkeys(WALKS[w][1] for w in walks))
    which = F.coalesce(*[F.when(F.col("relation").isin(*relations), F.lit(i)) for i, relations in enumerate(sets)])
    first = written(first_links(links.withColumn("set", which).filter("set is not null"), "set"), "steps")
    out = None
    for w in walks:
        forward, relations = WALKS[w]
        rows = directed(first.filter(F.col("set") == sets.index(relations)), forward).withColumn("direction", F.lit(w))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_links(links: DataFrame, *keys: str) -> DataFrame:
    """Of links between the same two nodes the first in link order, which hides the others."""
    return links.groupBy("source", "target", *keys).agg(F.min("relation").alias("relation"))


def directed(links: DataFrame, forward: bool) -> DataFrame:
    head, tail = ("source", "target") if forward else ("target", "source")
    return links.select(F.col(head).alias("id"), F.col(tail).alias("next"), "relation")


def levels(first: DataFrame, edges: DataFrame, depth: int = CHAIN_DEPTH) -> DataFrame:
    """direction, start, id, relation, level, rank of the nodes within depth of each start, each
    once. first: the edges whose ids are the starts; edges: steps(). All levels but the last are
    written out, as the next ones read them twice.

    The first to reach a node, in visiting order, gives its relation and rank. rank, the steps
    that lead to a node, sorts the nodes of a start's level in that order: where two of them part,
    both leave one node. What earlier levels have reached meets what is reached now in one
    aggregation, and sorts first, as it has no rank."""
    keys = ["start", "id", "direction"]
    step = lambda rank, next_, relation: F.concat(rank, F.array(F.struct(F.col(next_).alias("n"), F.col(relation).alias("r"))))
    none = F.expr("cast(array() as array<struct<n:string,r:string>>)")
    front = first.filter("id <> next").select(F.col("id").alias("start"), F.col("next").alias("id"), "direction", "relation", F.lit(1).alias("level"), none.alias("rank"))
    front = front.withColumn("rank", step("rank", "id", "relation"))
    out = front
    for level in range(2, depth + 1):
        reach = front.drop("relation", "level").join(edges, ["id", "direction"]).filter("next <> start")
        reach = reach.select("start", F.col("next").alias("id"), "direction", F.struct("rank", "relation").alias("b"))
        seen = out.select(*keys, F.lit(None).cast(reach.schema["b"].dataType).alias("b"))
        seen = seen.withColumn("b", F.struct(F.col("b.rank").alias("rank"), F.col("b.relation").alias("relation")))
        best = reach.unionByName(seen).repartition(*keys).groupBy(*keys).agg(F.min("b").alias("b")).filter("b.rank is not null")
        front = best.select(*keys, F.col("b.relation").alias("relation"), F.lit(level).alias("level"), F.col("b.rank").alias("rank")).withColumn("rank", step("rank", "id", "relation"))
        if level < depth:
            front = written(front, "level")
        out = out.unionByName(front)
    return out


def walk(starts: DataFrame, links: DataFrame, forward: bool, relations: tuple[str, ...] | None, depth: int = CHAIN_DEPTH) -> DataFrame:
    """start, id, relation, level, rank of the nodes within depth of each start (column start)."""
    rows = links if relations is None else links.filter(F.col("relation").isin(*relations))
    edges = written(directed(first_links(rows), forward).withColumn("direction", F.lit("")), "steps")
    return levels(_from(starts, edges), edges, depth).drop("direction")


def _from(starts: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(starts.select(F.col("start").alias("id")), "id", "left_semi")


def decorated(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with label and location of id: the id and `?` where they are missing."""
    return described(rows, last_by_id(nodes))


def described(rows: DataFrame, last: DataFrame) -> DataFrame:
    """decorated(), from nodes that are the last of their ids."""
    known = last.select("id", F.col("label").alias("l"), "source_file", "source_location")
    empty = lambda c: F.nullif(c, F.lit(""))
    location = F.concat(F.coalesce(empty(F.col("source_file")), F.lit("?")), F.lit(":"), F.coalesce(F.col("source_location").cast("string"), F.lit("?")))
    return rows.join(known, "id", "left").withColumn("label", F.coalesce(empty(F.col("l")), "id")).withColumn("location", location).drop("l", "source_file", "source_location")


def chains(starts: DataFrame, links: DataFrame) -> DataFrame:
    """came_from, led_to and nearby walks of every start, with a direction column."""
    edges = steps(links)
    return levels(_from(starts, edges), edges)


def show(nodes: DataFrame, links: DataFrame, wanted: str, rows: int = CHAIN_ROWS) -> str:
    """The three chains of one node as text, the first rows of each."""
    start = find_node(nodes, wanted)
    found = start.collect()
    if not found:
        return f"No node matches: {wanted}"
    out = [f"{found[0]['label']}"]
    table = written(decorated(chains(start.select(F.col("id").alias("start")), links), nodes), "chains")
    for name in ("came_from", "led_to", "nearby"):
        own = table.filter(F.col("direction") == name)
        got = own.orderBy("level", "rank").limit(rows + 1).collect()
        out.append(f"{name.replace('_', ' ')}:")
        out += [f"  {'  ' * (r['level'] - 1)}{r['relation']} {r['label']}  [{r['location']}]" for r in got[:rows]] or ["  none"]
        if len(got) > rows:
            out.append(f"  and {own.count() - rows} more")
    return "\n".join(out)
