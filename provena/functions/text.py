"""String expressions with Python's notions of white space, letters and digits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from ..schema import UNIT_SCALE

#: Characters that str.strip() removes and \s matches, as a Java class, and all others.
WS = r"[\s\p{Z}\x1c-\x1f\x85\x0b]"
NOT_WS = r"[^\s\p{Z}\x1c-\x1f\x85\x0b]"
#: A word's first character (a letter, but neither digit nor underscore), and any of its characters.
LETTER, WORD = r"[\p{L}\p{Nl}\p{No}]", r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def title_key(c: Column) -> Column:
    """The form in which titles and link targets are compared."""
    return collapse(F.translate(F.lower(strip(c)), "/:\\", "---"))


def stem(path: Column) -> Column:
    """File name without folders and its last ending."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?s)\A(.+)\.[^.]*\z", "$1")


@pandas_udf(DoubleType())
def base_value(number: pd.Series, unit: pd.Series) -> pd.Series:
    """A number's value in its base unit, rounded to three decimals as Python rounds."""
    return pd.Series([None if n is None else round(float(n.replace(",", "")) * UNIT_SCALE.get(u, (u, 1.0))[1], 3) for n, u in zip(number, unit, strict=True)], dtype="float64")


def base_unit(unit: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in UNIT_SCALE.items() for x in (k, v[0])])
    return F.coalesce(F.element_at(known, unit), unit)


@pandas_udf(StringType())
def float_text(values: pd.Series) -> pd.Series:
    """A number as Python prints it."""
    return values.map(lambda v: None if pd.isna(v) else str(float(v)))


@pandas_udf(StringType())
def short_number(values: pd.Series) -> pd.Series:
    """A number with six significant digits and no closing zeros."""
    return values.map(lambda v: None if pd.isna(v) else f"{v:g}")
