"""Command line: python -m provena.cli build | ask | path | explain | chain | score | conflicts | settle"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chain, conflicts, markdown, score, search, settle
from .sources import map_store
from .sources.config import Config
from .sources.notes import diagnosis, read_notes
from .streaming.refresh import rebuild


def _page(store: map_store.MapStore, nodes, watched, shown: int | None):
    """Numbered values of the first open conflicts, (name, signature) by number, and how many there are."""
    held = store.suppressions(nodes.sparkSession)
    strong = conflicts.strong_observations(nodes, watched)
    weak = conflicts.context_observations(nodes, strong)
    found = [conflicts.conflicts(rows, held) for rows in (strong, weak)]
    total = sum(f.filter("not suppressed").count() for f in found)
    paged = settle.page(*found)
    names = [r["name"] for r in paged.collect()]  # a page at most
    own = strong.unionByName(weak).filter(F.col("name").isin(names))
    return settle.choices(paged, conflicts.values(own, shown)), {r["index"]: (r["name"], r["signature"]) for r in paged.collect()}, total


def _lines(docs, by: str):
    """file, line, raw of every line of the documents."""
    rows = docs.select(F.col(by).alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("i", "raw"))
    return rows.select("file", (F.col("i") + 1).alias("line"), "raw")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="provena")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("--source", action="append")
    b.add_argument("--out")
    b.add_argument("--force", action="store_true")
    b.add_argument("--no-json", action="store_true", help="write the tables alone, not the JSON map beside them")
    b.add_argument("--quiet", action="store_true")
    sub.add_parser("ask").add_argument("words", nargs="+")
    for name in ("explain", "chain"):
        sub.add_parser(name).add_argument("name")
    two = sub.add_parser("path")
    two.add_argument("a")
    two.add_argument("b")
    sub.add_parser("score")
    sub.add_parser("conflicts")
    s = sub.add_parser("settle")
    s.add_argument("picks")
    s.add_argument("--confirm", action="store_true", help="rewrite documents; otherwise only show what would change")
    a = p.parse_args(args)

    c = Config.read(a.config)
    folders = (a.what == "build" and a.source) or list(c.source_dirs)
    path = (a.what == "build" and a.out) or c.map_path
    if not folders or not path:
        print("Nothing configured: give source folders and a map path.")
        return 0
    spark = SparkSession.builder.getOrCreate()
    store, watched = map_store.MapStore(path), tuple(c.watched_names)
    docs = read_notes(spark, folders)
    if a.what == "build":
        done = rebuild(spark, folders, path, watched, a.force, not a.no_json)
        note = diagnosis(folders, docs.count())
        if note:
            print(note)
        if not done:
            print("unchanged")
    if a.what in ("build", "score") and not getattr(a, "quiet", False):
        nodes, links = store.read(spark)
        row = score.hints(score.metrics(nodes, links)).first().asDict()
        lines = markdown.with_lines(docs.select(F.col("rel_path").alias("source_file"), "text")).select("source_file", F.explode("ls").alias("s")).select("source_file", F.col("s.line").alias("source_location"), "s.raw")
        checked = [r["verified"] for r in score.verify(score.samples(nodes), lines).collect()]
        print("\n".join([score.line(row, sum(checked), len(checked)), *row["hints"]]))
        return 0
    if a.what == "build":
        return 0
    nodes, links = store.read(spark)
    if a.what == "ask":
        print(search.render(search.answer(nodes, links, " ".join(a.words), c.answer_budget)) or "Nothing found.")
    elif a.what == "path":
        hops = search.shortest_path(nodes, links, a.a, a.b).orderBy("hop").collect()
        print("\n".join([f"{len(hops)} hop(s)", *(f"  {r['source']} --{r['relation']}--> {r['target']}" for r in hops)]) if hops else "No path.")
    elif a.what == "explain":
        for r in search.explain(nodes, links, a.name).orderBy("source", "target", "relation").toLocalIterator():
            print(f"{r['source']} --{r['relation']}--> {r['target']}")
    elif a.what == "chain":
        print(chain.show(nodes, links, a.name))
    elif a.what == "conflicts":
        numbered, _, total = _page(store, nodes, watched, 2)
        print(settle.render(numbered, total))
    elif a.what == "settle":
        numbered, marks, _ = _page(store, nodes, watched, None)
        # the map has paths inside the folders; documents are edited where they are
        places = docs.select("rel_path", "path").distinct()
        one = numbered.select("*", F.explode("sources").alias("source")).withColumn("rel_path", F.regexp_replace("source", ":[^:]*$", ""))
        moved = F.concat(F.coalesce("path", "rel_path"), F.lit(":"), F.substring_index("source", ":", -1))
        keys = ["index", "name", "choice", "number", "unit", "n_sources"]
        numbered = one.join(places, "rel_path", "left").groupBy(*keys).agg(F.collect_list(moved).alias("sources"))
        done = settle.settle(numbered, marks, a.picks, _lines(docs, "path"), lambda *parts: store.log(*parts), store.suppress, a.confirm)
        print("\n".join([*done.messages, done.line() + ("" if a.confirm else " - nothing was written, add --confirm")]))
    notice = map_store.stale_notice(map_store.stale(docs, store.time()))
    if notice:
        print(notice)
    return 0


if __name__ == "__main__":
    sys.exit(main())
