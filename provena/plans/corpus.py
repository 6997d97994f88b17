"""A notes corpus derived from the star-schema tables, by SQL that any engine runs alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Decisions link only inside blocks of BLOCK, so that chains stay bounded.
BLOCK = 20

_N = "chr(10)"


def _s(x: str) -> str:
    return f"cast({x} as string)"


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _when(cond: str, *parts: str) -> str:
    return f"case when {cond} then {_cat(*parts)} else '' end"


_k = "o_orderkey"
_at = f"({_k} % {BLOCK})"

DECISIONS = f"""select cast(0 as int) as src_ord, {_cat("'decisions/ADR '", _s(_k), "'.md'")} as rel_path, {_cat(
    _when(f"{_k} % 3 = 0", "'---'", _N, "'owner: '", "o_orderstatus", _N, "'---'", _N),
    "'# ADR '", _s(_k), _N, "'The order is '", "o_orderstatus", "' after '", _s(f"{_k} % 90 + 10"), "' days.'", _N,
    _when(f"{_at} >= 1", "'It builds on [[ADR '", _s(f"{_k} - 1"), "']] and waits.'", _N),
    "'## Relations'", _N,
    _when(f"{_at} >= 1 and {_k} % 2 = 0", "'- supersedes [[ADR '", _s(f"{_k} - 1"), "']]'", _N),
    _when(f"{_at} >= 3 and {_k} % 3 = 0", "'- caused_by [[ADR '", _s(f"{_k} - 3"), "'|the cause]]'", _N),
    _when(f"{_at} >= 5 and {_k} % 5 = 0", "'- 대체함 [[ADR '", _s(f"{_k} - 5"), "']]'", _N),
    _when(f"{_at} = 0", "'- caused_by [[ADR '", _s(f"{_k} + {BLOCK - 2}"), "']]'", _N),
    "'* done by '", "o_orderpriority", _N)} as text from orders"""

FACTS = f"""select cast(0 as int) as src_ord, {_cat("'facts/part '", _s("p_partkey"), "'.md'")} as rel_path, {_cat(
    "'# '", "replace(p_brand, '#', ' ')", "' Facts'", _N,
    "'- tray width: '", _s("p_partkey % 4 + 1"), "' m'", _N,
    "'bend radius is fixed at '", _s("100 * (p_partkey % 3 + 1)"), "' mm for '", "p_type", _N,
    "'- '", "p_type", "' height: '", _s("p_size % 3 + 1"), "' m'", _N,
    "'the fill level '", "p_type", "' '", _s("p_partkey % 5 * 10 + 10"), "' %'", _N,
    "'load of the run 5 m'", _N)} as text from part"""

INDEX = f"""select cast(1 as int) as src_ord, {_cat("'index/'", "n_name", "'.md'")} as rel_path, {_cat(
    "'# '", "n_name", "' Index'", _N,
    "'See [[adr   '", _s("n_nationkey * 7"), "']] and [[ADR/'", _s("n_nationkey"), "']] and [[ADR:'", _s("n_nationkey"), "']].'", _N,
    "'- covers [[ADR '", _s("n_nationkey + 1"), "']]'", _N,
    "'- 3 [[absent '", "n_name", "']]'", _N)} as text from nation"""

#: Web notes as they are, prose without any mark-up, and notes with nothing but their name or a link to themselves.
WEB = f"""select cast(2 as int) as src_ord, {_cat("'web/'", _s("page_id"), "'.html'")} as rel_path, html as text from pages"""

PROSE = f"""select cast(2 as int) as src_ord, {_cat("'prose/text '", _s("doc_id"), "'.md'")} as rel_path, text from documents"""

ALONE = f"""select cast(3 as int) as src_ord, {_cat("'alone/void '", _s("r_regionkey"), "case when r_regionkey % 2 = 0 then '.md' else '.html' end")} as rel_path,
  case when r_regionkey % 2 = 0 then '' else {_cat("'<a href=\"void '", _s("r_regionkey"), "'\">me</a>'")} end as text from region"""

NOTES_SQL = " union all ".join((DECISIONS, FACTS, INDEX, WEB, PROSE, ALONE))


TABLES = ("orders", "part", "nation", "pages", "documents", "region")


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and time of change of the files behind the notes."""
    jvm, out = spark.sparkContext._jvm, []
    for t in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        out += sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found)
    return tuple(out)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_ord, rel_path, text: a note for every order, part, nation, page, document and region."""
    sql = NOTES_SQL
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view := f"provena_{t}")
        sql = sql.replace(f"from {t}", f"from {view}")
    return spark.sql(sql)
