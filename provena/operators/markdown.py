"""Markdown documents to headings, statements and links, line by line.

All of it is row-local: a document's lines are an array, so extraction needs no exchange.
Only section attribution runs a window, over the lines of each document.
Input tables have a key column (kept), and text. Lines count from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LETTER, NOT_WS, WORD, WS, strip
from ..schema import KOREAN_RELATIONS

# (?d): as in Python only \n ends a line for . and $
TARGET = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
HEADING = rf"(?d)^(#{{1,6}}){WS}+(.*{NOT_WS}){WS}*$"
ITEM = rf"(?d)^{WS}*[-*]{WS}+(.*{NOT_WS}){WS}*$"
RELATION = rf"(?d)^{WS}*[-*]{WS}+({LETTER}{WORD}*){WS}+{TARGET}{WS}*$"
FENCE = "---"
# A first line that is a fence, and all from there to the end of the next line that is one
_FENCED = rf"[{WS}&&[^\n]]*{FENCE}[{WS}&&[^\n]]*(?:\n|\z)"
OPENS = rf"\A{_FENCED}"
FRONT = rf"(?s){OPENS}(?:.*?\n)??{_FENCED}"


def _lines(text: Column) -> Column:
    """Structs of line number and raw line, without the front matter. A fence that never
    closes takes the whole document."""
    raw = F.split(text, "\n", -1)
    numbered = F.transform(raw, lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("raw")))
    opens = strip(F.element_at(raw, 1)) == FENCE
    close = F.array_position(F.transform(F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))), strip), FENCE).cast("int")
    after = F.when(close > 0, F.slice(numbered, close + 2, F.greatest(F.size(raw) - close - 1, F.lit(0)))).otherwise(F.slice(numbered, 1, 0))
    return F.when(opens, after).otherwise(numbered)


def _is_heading(raw: Column) -> Column:
    return raw.rlike(HEADING)


def _content(raw: Column) -> Column:
    return F.when(raw.rlike(ITEM), F.regexp_extract(raw, ITEM, 1)).otherwise(strip(raw))


def with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("ls", _lines(F.coalesce("text", F.lit("")))).drop("text")


def _sections() -> Column:
    found = F.filter("ls", lambda x: _is_heading(x["raw"]))
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), F.regexp_extract(x["raw"], HEADING, 2).alias("title")))


def _statements() -> Column:
    body = F.filter("ls", lambda x: ~_is_heading(x["raw"]))
    lines = F.transform(body, lambda x: F.struct(x["line"].alias("line"), _content(x["raw"]).alias("statement")))
    return F.filter(lines, lambda x: x["statement"] != "")


def canonical_relation(word: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in KOREAN_RELATIONS.items() for x in kv])
    return F.coalesce(F.element_at(known, word), word)


def _links() -> Column:
    def of(x: Column) -> Column:
        raw, line = x["raw"], x["line"]
        named = F.array(F.struct(line.alias("line"), strip(F.regexp_extract(raw, RELATION, 2)).alias("target"), canonical_relation(F.regexp_extract(raw, RELATION, 1)).alias("relation")))
        loose = F.transform(F.regexp_extract_all(raw, F.lit(TARGET), F.lit(1)), lambda t: F.struct(line.alias("line"), strip(t).alias("target"), F.lit(None).cast("string").alias("relation")))
        return F.when(raw.rlike(RELATION), named).otherwise(loose)

    held = F.filter("ls", lambda x: x["raw"].contains("[[") & ~_is_heading(x["raw"]))
    return F.flatten(F.transform(held, of))


def parsed(docs: DataFrame, lines: bool = False) -> DataFrame:
    """key columns with the arrays sections, statements and links, on request also the lines
    (ls): every line is read once."""
    rows = with_lines(docs)
    keys = [c for c in rows.columns if c != "ls" or lines]
    return rows.select(*keys, _sections().alias("sections"), _statements().alias("statements"), _links().alias("links"))


def rows_of(table: DataFrame, piece: str) -> DataFrame:
    """One array of parsed() as rows: key columns, idx (from 0) and the piece's fields."""
    keys = [c for c in table.columns if c not in ("sections", "statements", "links")]
    return table.select(*keys, F.posexplode(piece).alias("idx", "s")).select(*keys, "idx", "s.*")


def sections(docs: DataFrame) -> DataFrame:
    """key columns, idx (from 0), line, title of every heading."""
    return rows_of(parsed(docs), "sections")


def statements(docs: DataFrame) -> DataFrame:
    """key columns, idx (from 0), line, statement: each line with content that is no heading."""
    return rows_of(parsed(docs), "statements")


def relations(docs: DataFrame) -> DataFrame:
    """key columns, target and relation of links(docs) that have a relation, in any order.

    Without line numbers no array is needed but that of the lines: front matter is cut from the
    text. No heading is a relation, as an item opens with - or *."""
    keys = [c for c in docs.columns if c != "text"]
    body = F.when(F.col("text").rlike(FRONT), F.regexp_replace("text", FRONT, "")).when(~F.col("text").rlike(OPENS), F.col("text"))
    lines = docs.filter(F.contains("text", F.lit("[["))).select(*keys, F.explode(F.split(body, "\n", -1)).alias("raw"))
    found = lines.filter(F.contains("raw", F.lit("[["))).filter(F.col("raw").rlike(RELATION))
    return found.select(*keys, strip(F.regexp_extract("raw", RELATION, 2)).alias("target"), canonical_relation(F.regexp_extract("raw", RELATION, 1)).alias("relation"))


def links(docs: DataFrame) -> DataFrame:
    """key columns, idx (from 0), line, target, relation (null for a mention) of every link."""
    return rows_of(parsed(docs), "links")


def attributed(docs: DataFrame) -> DataFrame:
    """Statements with the title of the latest heading above them, "" before any."""
    rows = with_lines(docs)
    keys = [c for c in rows.columns if c != "ls"]
    lines = rows.select(*keys, F.explode("ls").alias("s")).select(*keys, "s.line", "s.raw")
    title = F.when(_is_heading(F.col("raw")), F.regexp_extract("raw", HEADING, 2))
    above = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(above), F.lit("")))
    return lines.filter(~_is_heading(F.col("raw"))).select(*keys, "line", _content(F.col("raw")).alias("statement"), "section").filter("statement <> ''")


def bodies(docs: DataFrame) -> DataFrame:
    """key columns, line, title, body: each heading with the statements up to the next one,
    each closed by a newline."""
    rows = with_lines(docs)
    keys = [c for c in rows.columns if c != "ls"]
    lines = rows.select(*keys, F.explode("ls").alias("s")).select(*keys, "s.line", "s.raw")
    head = _is_heading(F.col("raw"))
    above = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("at", F.last(F.when(head, F.col("line")), ignorenulls=True).over(above)).filter("at is not null")
    text = F.when(~head, F.nullif(_content(F.col("raw")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("line", text.alias("c")))))
    return lines.groupBy(*keys, F.col("at").alias("line")).agg(F.max(F.when(head, F.regexp_extract("raw", HEADING, 2))).alias("title"), F.concat_ws("", F.transform(parts, lambda p: F.concat(p["c"], F.lit("\n")))).alias("body"))
