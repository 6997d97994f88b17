"""Values that two documents state differently.

Three passes collect (name, number, unit, source) observations: `name: value` pairs,
numbers soon after a watched name, and numbers named by the words before them. All work
row by row; names then meet in one aggregation by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WS, base_unit, base_value, collapse, float_text
from ..schema import CONTEXT_PREFIX, CONTEXT_WORDS, GENERIC_NAMES, NAME_LENGTH, NAME_WORD, NAME_WORDS, NUMBER, NUMBER_BEFORE, PAIR_NAME, PAIR_NUMBER, STOP_TAILS, UNIT_AFTER, UNIT_TAIL, UNITS, WATCH_BREAKERS, WATCH_WINDOW, WATCHED_NAMES

_UNIT = "|".join(UNITS)
VALUE = rf"{NUMBER_BEFORE}({NUMBER}){WS}*({_UNIT}){UNIT_AFTER}"
PAIR = rf"({PAIR_NAME}){WS}*[:=]{WS}*({PAIR_NUMBER}){WS}*({_UNIT}){UNIT_AFTER}"

#: What every label with an observation holds; so does its key, whatever its letter case.
HOLDS_VALUE = rf"(?iu)\p{{Nd}}{WS}*(?:{_UNIT})"


def name_of(c: Column) -> Column:
    return F.lower(collapse(c))


def _sourced(nodes: DataFrame) -> DataFrame:
    """text, file, line and ins of nodes; `?` for what is missing."""
    return nodes.select(F.coalesce("label", F.lit("")).alias("text"), F.coalesce(F.nullif("source_file", F.lit("")), F.lit("?")).alias("file"), F.coalesce(F.col("source_location").cast("string"), F.lit("?")).alias("line"), F.struct("id", "ins").alias("at"))


def _valued(rows: DataFrame) -> DataFrame:
    return rows.select("name", base_value("n", "u").alias("number"), base_unit(F.col("u")).alias("unit"), "file", "line", "at")


def named(nodes: DataFrame) -> DataFrame:
    """Observations of `name: value` and `name = value`."""
    rows = _sourced(nodes).filter(F.col("text").rlike(r"[:=]"))
    found = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(PAIR), F.lit(i)).alias(a) for i, a in ((1, "k"), (2, "n"), (3, "u"))])
    rows = rows.select("file", "line", "at", F.explode(found).alias("f")).select("file", "line", "at", name_of(F.col("f.k")).alias("name"), "f.n", "f.u")
    return _valued(rows.filter(~F.col("name").isin(*GENERIC_NAMES) & (F.length("name") >= 2)))


def watched(nodes: DataFrame, names: tuple[str, ...] = WATCHED_NAMES) -> DataFrame:
    """Observations of the first number after each watched name."""
    if any(not n for n in names):
        raise ValueError("an empty name cannot be watched")
    rows = _sourced(nodes)
    reach = WATCH_WINDOW + UNIT_TAIL
    if not names:
        return _valued(rows.filter("false").withColumns({c: F.lit("") for c in ("name", "n", "u")}))
    hits = F.array(*[F.struct(F.lit(collapse_py(n)).alias("name"), F.regexp_extract_all("text", F.lit(rf"(?iu)\Q{n}\E(?=([\s\S]{{0,{reach}}}))"), F.lit(1)).alias("after")) for n in names])
    rows = rows.select("file", "line", "at", F.explode(F.filter(hits, lambda h: F.size(h["after"]) > 0)).alias("h"))
    rows = rows.select("file", "line", "at", "h.name", F.explode("h.after").alias("w")).filter(F.col("w").rlike(VALUE))
    before = F.regexp_extract("w", rf"(?s)\A(.*?){VALUE}", 1)
    broken = F.lit(False)
    for b in WATCH_BREAKERS:
        broken = broken | F.contains(before, F.lit(b))
    rows = rows.filter((F.length(before) < WATCH_WINDOW) & ~broken)
    return _valued(rows.select("file", "line", "at", "name", F.regexp_extract("w", VALUE, 1).alias("n"), F.regexp_extract("w", VALUE, 2).alias("u")))


def collapse_py(name: str) -> str:
    return " ".join(name.lower().split())


def context_name(prefix: Column) -> Column:
    """The name that the words before a number give, "" when they read as a phrase."""
    words = F.regexp_extract_all(prefix, F.lit(NAME_WORD), F.lit(0))
    last = F.filter(F.slice(words, F.greatest(F.size(words) - CONTEXT_WORDS + 1, F.lit(1)), CONTEXT_WORDS), lambda w: F.length(w) > 1)
    name = F.lower(F.array_join(F.slice(last, F.greatest(F.size(last) - NAME_WORDS + 1, F.lit(1)), NAME_WORDS), " "))
    ok = (F.size(last) > 0) & ~F.lower(F.element_at(last, -1)).isin(*STOP_TAILS) & (F.length(name) >= NAME_LENGTH)
    return F.when(ok, name).otherwise("")


def context(nodes: DataFrame) -> DataFrame:
    """Observations of numbers named by the words before them.

    Matches are marked and the text split at the marks; a match's prefix is all text before
    it, which marks of control characters (dropped from the text first) leave unchanged.
    """
    rows = _sourced(nodes).filter(F.col("text").rlike(VALUE))
    clean = F.translate("text", "\x01\x02\x03\x04", "    ")
    pieces = F.split(F.regexp_replace(clean, VALUE, "\x01$1\x03$2\x02$0\x04"), "\x01", -1)
    plain = lambda p: F.regexp_replace(p, r"(?s)\A[^\x02]*\x02([^\x04]*)\x04", "$1")
    rows = rows.withColumn("ps", pieces).withColumn("plain", F.transform("ps", lambda p, i: F.when(i > 0, plain(p)).otherwise(p)))
    # only the last CONTEXT_PREFIX characters count, so that many pieces before are enough
    near = F.transform(F.sequence(F.lit(2), F.size("ps")), lambda k: F.struct(F.element_at("ps", k).alias("p"), F.right(F.array_join(F.slice("plain", F.greatest(k - CONTEXT_PREFIX, F.lit(1)), F.least(k - 1, F.lit(CONTEXT_PREFIX))), ""), F.lit(CONTEXT_PREFIX)).alias("before")))
    rows = rows.select("file", "line", "at", F.explode(near).alias("m"))
    rows = rows.select("file", "line", "at", context_name(F.col("m.before")).alias("name"), F.substring_index("m.p", "\x03", 1).alias("n"), F.regexp_extract("m.p", "(?s)\\A[^\x03]*\x03([^\x02]*)\x02", 1).alias("u"))
    return _valued(rows.filter((F.col("name") != "") & ~F.col("name").isin(*GENERIC_NAMES)))


def strong_observations(nodes: DataFrame, names: tuple[str, ...] = WATCHED_NAMES) -> DataFrame:
    """Pairs, but for watched names only what the watch found."""
    pairs = named(nodes).filter(~F.col("name").isin(*[n.lower() for n in names])) if names else named(nodes)
    watch = watched(nodes, names)
    taken = watch.select("name").distinct()
    return pairs.join(taken, "name", "left_anti").unionByName(watch)


def context_observations(nodes: DataFrame, strong: DataFrame) -> DataFrame:
    return context(nodes).join(strong.select("name").distinct(), "name", "left_anti")


def values(observations: DataFrame, shown: int | None = None) -> DataFrame:
    """name, number, unit, n_sources, sources: each value with its distinct sources in node
    order, all of them or the first `shown`: then no row grows with the sources of a value.
    All are asked for only for the names of one page."""
    value = ["name", "number", "unit"]
    one = observations.groupBy(*value, "file", "line").agg(F.min("at").alias("at"))
    counted = one.groupBy(*value).agg(F.count(F.lit(1)).alias("n_sources"))
    first = one
    if shown is not None:
        order = Window.partitionBy(*value).orderBy("at", "file", "line")
        first = one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= shown)
    ordered = F.array_sort(F.collect_list(F.struct("at", F.concat("file", F.lit(":"), "line").alias("s"))))
    return counted.join(first.groupBy(*value).agg(F.transform(ordered, lambda x: x["s"]).alias("sources")), value)


def split_names(observations: DataFrame) -> DataFrame:
    """name, n_values, n_units, n_files, signature of every name.

    Values and files are made distinct first, by aggregations that combine on the map side."""
    value = observations.select("name", "number", "unit").distinct().withColumn("text", F.concat(float_text("number"), "unit"))
    order = F.array_sort(F.collect_list(F.struct("number", "unit", "text")))
    by_name = value.groupBy("name").agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct("unit").alias("n_units"), F.array_join(F.transform(order, lambda x: x["text"]), "|").alias("signature"))
    files = observations.groupBy("name").agg(F.countDistinct("file").alias("n_files"))
    return by_name.join(files, "name").select("name", "n_values", "n_units", "n_files", "signature")


def conflicts(observations: DataFrame, suppressions: DataFrame) -> DataFrame:
    """name, n_values, signature, suppressed of names with two values or more in one unit, in
    two files or more. A suppression holds while the signature is as it was."""
    found = split_names(observations).filter("n_values > 1 and n_units = 1 and n_files > 1")
    held = suppressions.select("name", F.col("signature").alias("held"))
    return found.join(held, "name", "left").select("name", "n_values", "signature", F.coalesce(F.col("held") == F.col("signature"), F.lit(False)).alias("suppressed"))


def counts(strong: DataFrame, weak: DataFrame, suppressions: DataFrame) -> DataFrame:
    """One row: names, context_names, split, suppressed."""
    s = split_names(strong).agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("n_values") > 1).alias("split"))
    w = weak.agg(F.countDistinct("name").alias("context_names"))
    hidden = conflicts(strong, suppressions).unionByName(conflicts(weak, suppressions)).agg(F.count_if("suppressed").alias("suppressed"))
    return s.crossJoin(w).crossJoin(hidden)
