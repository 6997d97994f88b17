"""Questions, shortest paths and neighbourhoods.

The specification is this project's own. Tokens are lower-cased runs of letters and digits.
A label scores the number of distinct question tokens in it; ties go to fewer label tokens,
then to node order. The best nodes are seeds; around them an undirected walk collects nodes
up to a depth. Answers are cut where the running length of labels passes the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..schema import ANSWER_BUDGET, NAMED_DOCUMENTS
from ..sources.shared import written
from .chain import edge_order, expand, find_node
from .graph import last_by_id

TOKEN = r"[\p{L}\p{N}]+"
SEEDS, DEPTH, HOPS = 3, 2, 6


def tokens(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))


def seeds(nodes: DataFrame, question: str, count: int = SEEDS) -> DataFrame:
    """id, label, score, label_tokens and seed_rank (from 1) of the best nodes."""
    asked = tokens(F.lit(question))
    # a token of both is a part of the label, which is cheaper to see than tokens are to cut out
    held = F.exists(asked, lambda t: F.contains(F.lower("label"), t))
    rows = nodes.filter(held).withColumn("own", tokens(F.col("label"))).withColumn("score", F.size(F.array_intersect("own", asked))).filter("score > 0")
    top = rows.withColumn("label_tokens", F.size("own")).orderBy(F.desc("score"), "label_tokens", "id", "ins").limit(count)
    # at most `count` rows, so one partition is enough to number them
    order = Window.orderBy(F.desc("score"), "label_tokens", "id", "ins")
    return top.withColumn("seed_rank", F.row_number().over(order)).select("id", "label", "score", "label_tokens", "seed_rank")


def undirected(links: DataFrame) -> DataFrame:
    """id, next, relation, e, forward: every link both ways, repeated ones too."""
    e = edge_order(F.col("source"), F.col("target"), F.col("relation")).alias("e")
    there = links.select(F.col("source").alias("id"), F.col("target").alias("next"), "relation", e, F.lit(True).alias("forward"))
    back = links.select(F.col("target").alias("id"), F.col("source").alias("next"), "relation", e, F.lit(False).alias("forward"))
    return there.unionByName(back)


def neighbourhood(starts: DataFrame, links: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, level and rank of all nodes within depth of the seeds, each once. starts: id, seed_rank."""
    edges = undirected(links)
    first = F.array(F.struct(F.lpad(F.col("seed_rank").cast("string"), 9, "0").alias("s"), F.lit("").alias("t"), F.lit("").alias("r")))
    front = starts.groupBy("id").agg(F.min("seed_rank").alias("seed_rank")).select(F.lit("q").alias("start"), "id", first.alias("rank"))
    out = front.select("id", F.lit(0).alias("level"), "rank")
    seen = front
    for level in range(1, depth + 1):
        front = expand(front, seen, edges).select("start", "id", "rank")
        out = out.unionByName(front.select("id", F.lit(level).alias("level"), "rank"))
        seen = seen.unionByName(front)
    return out


def answer(nodes: DataFrame, links: DataFrame, question: str, budget: int = ANSWER_BUDGET) -> DataFrame:
    """place, id, label, kind, source_file, source_location, level, truncated: nodes in reading
    order while their labels fit the budget; truncated tells whether some were cut.

    A label has one character or more, or counts as one here, so the first budget + 1 nodes in
    reading order are enough to fill the budget and to see whether it was: only those, a
    distributed top-k, meet in one window.
    """
    found = neighbourhood(written(seeds(nodes, question), "seeds"), links)
    own = written(nodes.join(found.select("id"), "id", "left_semi"), "near")
    found = found.join(last_by_id(own), "id")
    first = found.orderBy("level", "rank", "id").limit(budget + 1)
    order = Window.orderBy("level", "rank", "id")
    size = F.greatest(F.length("label"), F.lit(1))
    rows = written(first.withColumn("place", F.row_number().over(order)).withColumn("used", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))), "answer")
    cut = rows.agg(F.coalesce(F.max("used") > budget, F.lit(False)).alias("truncated"))
    return rows.filter(F.col("used") <= budget).crossJoin(cut).select("place", "id", "label", "kind", "source_file", "source_location", "level", "truncated")


def condensed(rows: DataFrame, by_line: bool = True) -> DataFrame:
    """Located statements in reading order, seeds first. by_line: a node on line 1 is a
    document; otherwise its kind tells."""
    whole = (F.col("source_location") == 1) if by_line else (F.col("kind") == "document")
    located = rows.filter("source_location is not null and source_file <> ''")
    return located.filter(~whole).select("place", "label", "source_file", "source_location", "truncated")


def touched(rows: DataFrame, by_line: bool = True, shown: int = NAMED_DOCUMENTS) -> DataFrame:
    """One row: the first documents of an answer, and how many more there are."""
    whole = (F.col("source_location") == 1) if by_line else (F.col("kind") == "document")
    docs = rows.filter("source_location is not null and source_file <> ''").filter(whole).groupBy("label").agg(F.min("place").alias("place"))
    top = docs.orderBy("place").limit(shown).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), ", ").alias("documents"))
    return top.crossJoin(docs.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("more")))


def render(rows: DataFrame) -> str:
    """An answer as text."""
    got = condensed(rows).orderBy("place").collect()
    out = [f"NODE {r['label']}\n     [src={r['source_file']} loc={r['source_location']}]" for r in got]
    tail = touched(rows).first()
    if tail and tail["documents"]:
        out.append(f"\n[also touched: {tail['documents']}" + (f" and {tail['more']} more]" if tail["more"] else "]"))
    if any(r["truncated"] for r in got):
        out.append("\n[The answer filled the budget and was cut. Ask with narrower words.]")
    return "\n".join(out)


def _named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.lower(strip(F.col("label"))) == F.lower(F.lit(name.strip()))).orderBy("id", "ins").limit(1).select("id")


def shortest_path(nodes: DataFrame, links: DataFrame, a: str, b: str, hops: int = HOPS) -> DataFrame:
    """hop, source, relation, target of a shortest undirected path between two full names, the
    first in link order; empty beyond `hops`."""
    edges = undirected(links)
    front = _named(nodes, a).select(F.lit("q").alias("start"), "id", F.expr("cast(array() as array<struct<s:string,t:string,r:string>>)").alias("rank"))
    front, goal = written(front, "start"), written(_named(nodes, b), "goal")
    reached, seen = front.withColumn("level", F.lit(0)), front
    for level in range(1, hops + 1):
        front = expand(front, seen, edges).select("start", "id", "rank")
        reached = reached.unionByName(front.withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
    best = reached.join(goal, "id", "left_semi").orderBy("level", "rank").limit(1)
    return best.select(F.posexplode("rank").alias("i", "e")).select((F.col("i") + 1).alias("hop"), F.col("e.s").alias("source"), F.col("e.r").alias("relation"), F.col("e.t").alias("target"))


def explain(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """source, relation, target, direction of every link at the node that find_node gives."""
    one = find_node(nodes, name).select("id")
    out = links.join(one.withColumnRenamed("id", "source"), "source", "left_semi").select("source", "relation", "target", F.lit("out").alias("direction"))
    back = links.filter("source <> target").join(one.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "relation", "target", F.lit("in").alias("direction"))
    return out.unionByName(back)
