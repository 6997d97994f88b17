"""Assembly of the provenance graph: nodes with file and line, and directed links.

Input: notes with src_ord int, rel_path string, text string. Places where order can be
seen carry it: `ord` orders documents (a folder's own files before its sub-folders), `ins`
orders nodes of equal id. Nodes and links are bags; rows of equal ids stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem, title_key
from ..schema import HTML_SUFFIXES
from ..sources.shared import written
from . import html, markdown

KEY = ["doc_id", "path", "ord"]


def document_order(path: Column) -> Column:
    """A sortable key: files of a folder come before those of its sub-folders."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda c, i: F.concat(F.when(i < F.size(parts) - 1, "1").otherwise("0"), c))


def document_id(key: Column) -> Column:
    return F.concat(F.lit("doc_"), F.replace(key, F.lit(" "), F.lit("_")))


def name_id(key: Column) -> Column:
    return F.concat(F.lit("name_"), F.replace(key, F.lit(" "), F.lit("_")))


def is_document(id_: str) -> Column:
    """Of an end of a link that documents write: whether it is a document's id, or else a name's."""
    return F.col(id_).startswith("doc_")


def unwritten(rows: DataFrame, label: str) -> DataFrame:
    return rows


@dataclass
class Pieces:
    documents: DataFrame
    sections: DataFrame
    statements: DataFrame
    links: DataFrame


def _tagged(notes: DataFrame) -> DataFrame:
    rows = notes.select(F.struct(F.col("src_ord").alias("s"), document_order(F.col("rel_path")).alias("p")).alias("ord"), F.col("rel_path").alias("path"), "text")
    rows = rows.withColumn("name", stem(F.col("path"))).withColumn("key", title_key(F.col("name"))).withColumn("doc_id", document_id(F.col("key")))
    return rows.select("doc_id", "path", "ord", "text", "name", "key")


def parsed(notes: DataFrame, lines: bool = False) -> DataFrame:
    """doc_id, path and ord of every document with the arrays sections, statements and links, on
    request also its lines (ls: line, raw)."""
    is_html = F.lit(False)
    for ending in HTML_SUFFIXES:
        is_html = is_html | F.col("path").endswith(ending)
    tagged = _tagged(notes).drop("name", "key")
    web = tagged.filter(is_html)
    web = html.parsed(web.withColumn("whole", F.col("text")) if lines else web)
    if lines:
        web = markdown.with_lines(web.withColumnRenamed("whole", "text"))
    web = web.select(*KEY, *(["ls"] if lines else []), *html.without_tags())
    return markdown.parsed(tagged.filter(~is_html), lines).unionByName(web)


def parse(notes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = written) -> Pieces:
    """Documents, and the pieces of each, tagged with its doc_id, path and order. Every document
    is parsed once, to a table of arrays that the three kinds of pieces are read from; where few
    rows of one kind are wanted, `keep` can be `unwritten`."""
    table = keep(parsed(notes), "parsed")
    of = lambda piece, *fields: markdown.rows_of(table, piece).select(*KEY, "idx", "line", *fields)
    return Pieces(_tagged(notes).select(*KEY, "name", "key"), of("sections", "title"), of("statements", "statement"), of("links", "target", "relation"))


def key_dictionary(documents: DataFrame) -> DataFrame:
    """key -> doc_id, which its key alone gives."""
    return documents.select("key").distinct().withColumn("to_id", document_id(F.col("key")))


def resolve(pieces: Pieces) -> DataFrame:
    """Every link piece with key, to_id (a document's, else a name's) and found."""
    rows = pieces.links.withColumn("key", title_key(F.col("target"))).join(key_dictionary(pieces.documents), "key", "left")
    return rows.withColumn("found", F.col("to_id").isNotNull()).withColumn("to_id", F.coalesce("to_id", name_id(F.col("key"))))


def _node(id_: Column, label: str, kind: str, path: Column, line: Column, phase: int, sub: int, ord_: Column, idx: Column) -> list[Column]:
    ins = F.struct(F.lit(phase).alias("phase"), ord_.alias("ord"), F.lit(sub).alias("sub"), idx.cast("long").alias("idx"))
    return [id_.alias("id"), F.col(label).alias("label"), F.lit(kind).alias("kind"), path.alias("source_file"), line.cast("int").alias("source_location"), ins.alias("ins")]


def nodes(pieces: Pieces, keep: Callable[[DataFrame, str], DataFrame] = unwritten) -> DataFrame:
    """id, label, kind, source_file, source_location, ins. All but names without a document,
    which go through `keep`, are read from the documents with no exchange."""
    return _document_nodes(pieces.documents).unionByName(_piece_nodes(pieces)).unionByName(keep(_name_nodes(pieces), "names"))


def _document_nodes(documents: DataFrame) -> DataFrame:
    c = F.col
    return documents.select(*_node(c("doc_id"), "name", "document", c("path"), F.lit(1), 0, 0, c("ord"), F.lit(0)))


def _piece_nodes(pieces: Pieces) -> DataFrame:
    c = F.col
    sections = pieces.sections.select(*_node(F.concat("doc_id", F.lit("_s"), "idx"), "title", "section", c("path"), c("line"), 1, 0, c("ord"), c("idx")))
    return sections.unionByName(pieces.statements.select(*_node(F.concat("doc_id", F.lit("_t"), "idx"), "statement", "statement", c("path"), c("line"), 1, 1, c("ord"), c("idx"))))


def _name_nodes(pieces: Pieces) -> DataFrame:
    c, lost = F.col, resolve(pieces).filter(~F.col("found"))
    first = lost.groupBy("key").agg(F.min_by("target", F.struct("ord", "idx")).alias("target"), F.min(F.struct("ord", "idx")).alias("at"))
    return first.select(*_node(name_id(c("key")), "target", "name_only", F.lit(""), F.lit(None), 1, 2, c("at.ord"), c("at.idx")))


def matching(notes: DataFrame, pattern: str) -> DataFrame:
    """nodes(parse(notes)) whose label matches pattern, without a table of all nodes.

    pattern must match a text's key where it matches the text, so it may ask for no letter case
    and no kind of white space. Markdown labels are parts of their document's text: documents
    without a match are not parsed. A missing name and the documents it could name share a key,
    so keys without a match take no part in the join."""
    web = _web()
    c, named = F.col, parse(notes.withColumn("text", F.lit("")), unwritten).documents.filter(F.col("key").rlike(pattern))
    all_ = parse(notes.filter(web | c("text").rlike(pattern)), unwritten)
    links = all_.links.filter(title_key(c("target")).rlike(pattern))
    found = Pieces(named, all_.sections.filter(c("title").rlike(pattern)), all_.statements.filter(c("statement").rlike(pattern)), links)
    return nodes(found).filter(c("label").rlike(pattern))


def suppress_mentions(links: DataFrame) -> DataFrame:
    """Drop mentions between two nodes that another relation links the same way."""
    plain = F.col("relation") == "mentions"
    named = links.filter(~plain)
    lone = links.filter(plain).join(named.select("source", "target"), ["source", "target"], "left_anti")
    return named.unionByName(lone.select("source", "target", "relation"))


def part_links(pieces: Pieces) -> DataFrame:
    """Sections and statements, each with its document."""
    part = F.lit("part_of").alias("relation")
    own = [p.select(F.concat("doc_id", F.lit(tag), "idx").alias("source"), F.col("doc_id").alias("target"), part) for p, tag in ((pieces.sections, "_s"), (pieces.statements, "_t"))]
    return own[0].unionByName(own[1])


def named_links(pieces: Pieces) -> DataFrame:
    """The links that documents write, before mentions are dropped."""
    return resolve(pieces).select(F.col("doc_id").alias("source"), F.col("to_id").alias("target"), F.coalesce("relation", F.lit("mentions")).alias("relation"))


def all_links(pieces: Pieces) -> DataFrame:
    """source, target, relation before mentions are dropped."""
    return part_links(pieces).unionByName(named_links(pieces))


def kept_links(pieces: Pieces) -> DataFrame:
    """links(pieces) but for part_of links of sections and statements, written out.

    A part_of link stands between the ends of a mention only where the mentioning document's
    own id reads as that of a piece of the other, as does `a_s0` of `a`. Such mentions, few if
    any, are looked up among the pieces; all others meet written links alone."""
    named = written(named_links(pieces), "named")
    odd = (F.col("relation") == "mentions") & F.col("source").startswith(F.col("target")) & F.col("source").rlike(r"_[st][0-9]+\z")
    asked = written(named.filter(odd).select("source", "target").distinct(), "odd")
    part = part_links(pieces).join(asked, ["source", "target"], "left_semi") if not asked.isEmpty() else None
    if part is None:
        return written(suppress_mentions(named), "links")
    every = suppress_mentions(named.unionByName(part.withColumn("relation", F.lit("\0part_of"))))
    return written(every.filter(F.col("relation") != "\0part_of"), "links")


def links(pieces: Pieces) -> DataFrame:
    return part_links(pieces).unionByName(kept_links(pieces))


def _web() -> Column:
    found = F.lit(False)
    for ending in HTML_SUFFIXES:
        found = found | F.col("rel_path").endswith(ending)
    return found


def relation_links(notes: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    """The links of links(parse(notes)) with one of these relations.

    relations hold neither mentions, which others suppress, nor part_of, which pieces have. Only
    markdown writes others, so nothing else is parsed, and of that no more than lines with links."""
    rows = markdown.relations(_tagged(notes.filter(~_web())).select("doc_id", "text")).filter(F.col("relation").isin(*relations))
    ends = rows.select(F.col("doc_id").alias("source"), title_key(F.col("target")).alias("key"), "relation")
    ends = ends.join(key_dictionary(_tagged(notes)), "key", "left")
    return ends.select("source", F.coalesce("to_id", name_id(F.col("key"))).alias("target"), "relation")


def looked_up(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """last_by_id(nodes(parse(notes))) of all documents, and of ids (column id) that others have.

    A name's id tells that it is one, and a piece's ends with its number; only where such ids are
    asked for, links are read for the names and documents parsed whose pieces could have them."""
    c = F.col
    piece = r"(?s)\A(.*)_[st](?:0|[1-9][0-9]*)\z"
    asked = written(ids.filter(~is_document("id") | c("id").rlike(piece)).select("id").distinct(), "asked")
    names, pieces = asked.filter(~is_document("id")), asked.filter(is_document("id"))
    rows = _document_nodes(_tagged(notes))
    if not names.isEmpty():
        all_ = parse(notes, unwritten)
        all_.links = all_.links.withColumn("id", name_id(title_key(c("target")))).join(names, "id", "left_semi").drop("id")
        rows = rows.unionByName(_name_nodes(all_))
    if not pieces.isEmpty():
        owners = pieces.select(F.regexp_extract("id", piece, 1).alias("of")).distinct()
        whole = parse(notes.withColumn("of", document_id(title_key(stem(c("rel_path"))))).join(owners, "of", "left_semi").drop("of"), unwritten)
        rows = rows.unionByName(_piece_nodes(whole).join(pieces, "id", "left_semi"))
    return last_by_id(rows)


def ordered_nodes(rows: DataFrame) -> DataFrame:
    """Canonical order: by id, rows of one id as they were made."""
    return rows.orderBy("id", "ins").drop("ins")


def ordered_links(rows: DataFrame) -> DataFrame:
    return rows.orderBy("source", "target", "relation")


def last_by_id(rows: DataFrame) -> DataFrame:
    """One row per id, the last in node order: what a lookup by id sees."""
    return rows.groupBy("id").agg(F.max_by(F.struct("label", "kind", "source_file", "source_location"), "ins").alias("n")).select("id", "n.*")


def summary(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: documents, nodes, links, located, relation_kinds."""
    n = rows.agg(F.count_if(F.col("kind") == "document").alias("documents"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("source_location").isNotNull()).alias("located"))
    e = edges.agg(F.count(F.lit(1)).alias("links"), F.countDistinct("relation").alias("relation_kinds"))
    return n.crossJoin(e)
