"""Settling conflicts: numbered pages, picks, where values stand, and guarded rewriting.

Everything up to the edits is tables: picks join the numbered values, what is not kept is
looked for in the lines, and each hit is one edit. Values are matched on number boundaries
(`5 m` is not found in `15 m` or `5 mm`), and line ends stay as they are. Files are edited
on the driver only, once each, and only with confirm=True.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from ..schema import CONFLICT_PAGE, PREVIEW


def page(strong: DataFrame, weak: DataFrame, size: int = CONFLICT_PAGE) -> DataFrame:
    """index, name, signature of the first open conflicts: strong ones by name, then the rest."""
    rows = strong.withColumn("pass", F.lit(1)).unionByName(weak.withColumn("pass", F.lit(2))).filter("not suppressed")
    first = rows.orderBy("pass", "name").limit(size)
    return first.withColumn("index", F.row_number().over(Window.orderBy("pass", "name"))).select("index", "name", "signature", "pass")


def choices(paged: DataFrame, values: DataFrame) -> DataFrame:
    """index, name, choice, number, unit, n_sources, sources: a conflict's values, numbered upwards."""
    order = Window.partitionBy("index").orderBy("number", "unit")
    return paged.join(values, "name").withColumn("choice", F.row_number().over(order)).select("index", "name", "choice", "number", "unit", "n_sources", "sources")


@dataclass(frozen=True)
class Pick:
    index: int
    choice: int


_PICK = re.compile(r"(?P<index>[0-9]+):(?P<choice>[0-9]+)|(?P<other>[^\s,]+)")


def parse_picks(text: str) -> tuple[list[Pick], list[str]]:
    """Picks like "1:2 2:3" (commas too), and the words that are none."""
    found = [re.fullmatch(_PICK, word) for word in re.findall(r"[^\s,]+", text)]
    return [Pick(int(m["index"]), int(m["choice"])) for m in found if not m["other"]], [m["other"] for m in found if m["other"]]


def spellings(number: float, unit: str) -> list[str]:
    """How a value may be written; the first is what is written back."""
    forms = [(number, unit)]
    if unit == "m":
        forms += [(round(number * k), u) for k, u in ((1000, "mm"), (100, "cm")) if abs(number * k - round(number * k)) < 1e-6]
    return [f"{v:g}{space}{u}" for v, u in forms for space in (" ", "")]


def pattern(number: float, unit: str) -> str:
    """An expression for any spelling, on number and unit boundaries."""
    return r"(?<![\d.,])(?:" + "|".join(re.escape(s) for s in spellings(number, unit)) + r")(?![A-Za-z0-9])"


def _per_value(f: Callable[[float, str], str]):
    def column(number: pd.Series, unit: pd.Series) -> pd.Series:
        return pd.Series([f(n, u) for n, u in zip(number, unit, strict=True)], dtype=object)

    return F.pandas_udf(column, "string")


def spelled(values: DataFrame) -> DataFrame:
    """values (number, unit) with `spellings`, divided by bars, and `rx`, the expression for them."""
    forms = _per_value(lambda n, u: "|".join(spellings(n, u)))
    return values.withColumn("spellings", forms("number", "unit")).withColumn("rx", _per_value(pattern)("number", "unit"))


def picked(numbered: DataFrame, kept: DataFrame) -> DataFrame:
    """What has to change: index, name, number, unit, rx, file, line and new_text, one row for
    each source of a value that is not kept. numbered: choices() with all sources; kept: index, choice."""
    keep = numbered.join(kept, ["index", "choice"]).select("index", F.col("choice").alias("keep"), "number", "unit")
    new = spelled(keep).select("index", "keep", F.split("spellings", r"\|")[0].alias("new_text"))
    rows = spelled(numbered.join(new, "index").filter("choice <> keep"))
    rows = rows.select("index", "name", "number", "unit", "rx", "new_text", F.explode("sources").alias("source"))
    line = F.substring_index("source", ":", -1).try_cast("int")
    return rows.select("index", "name", "number", "unit", "rx", F.regexp_replace("source", ":[^:]*$", "").alias("file"), F.coalesce(line, F.lit(-1)).alias("line"), "new_text")


def plan(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """Where the values to be replaced stand (a dry run): index, name, file, line, number, unit,
    raw, at_source, and rx and new_text as they come. wanted: picked(); lines: file, line, raw.

    The recorded line is taken if it has the value; otherwise the file's lines that have it
    with all words of the name, or where no line has those, all that have the value. Two
    sources of one file that lead to one line are one row."""
    hits = wanted.withColumnRenamed("line", "recorded").join(lines, "file").filter(F.expr("raw rlike rx"))
    words = F.filter(F.split("name", r"[\s/]+"), lambda w: F.length(w) > 1)
    named = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.lower("raw"), F.lower(w)))
    hits = hits.withColumn("worth", F.when(F.col("line") == F.col("recorded"), 0).when(named, 1).otherwise(2))
    source = ["index", "file", "recorded", "number", "unit"]
    best = hits.groupBy(*source).agg(F.min("worth").alias("worth"))
    rows = hits.join(best, [*source, "worth"]).groupBy("index", "name", "file", "line", "number", "unit", "rx", "new_text")
    return rows.agg(F.first(F.substring(strip(F.col("raw")), 1, PREVIEW)).alias("raw"), (F.min("worth") == 0).alias("at_source"))


@dataclass(frozen=True)
class Edit:
    name: str
    file: str
    line: int
    rx: str
    new_text: str


def apply(edits: Iterable[Edit], confirm: bool = False) -> list[tuple[Edit, bool, str]]:
    """Each edit with whether it could be made, and the text it replaced or the reason. A file is
    read and, with confirm, written once, in one step; lines keep their ends."""
    out = []
    for file, own in groupby(sorted(edits, key=lambda e: (e.file, e.line, e.rx)), key=lambda e: e.file):
        try:
            with open(file, encoding="utf-8", newline="") as f:
                lines = f.read().split("\n")
        except OSError as e:
            out += [(edit, False, e.strerror or "unreadable") for edit in own]
            continue
        touched = False
        for edit in own:
            at = edit.line - 1
            found = re.search(edit.rx, lines[at]) if 0 <= at < len(lines) else None
            if found:
                lines[at] = lines[at][: found.start()] + edit.new_text + lines[at][found.end() :]
                touched = True
            out.append((edit, bool(found), found[0] if found else "no such value there any more"))
        if touched and confirm:
            with open(partial := f"{file}.part", "w", encoding="utf-8", newline="") as f:
                f.write("\n".join(lines))
            os.replace(partial, file)
    return out


@dataclass
class Settled:
    """Counts of edits made (or found, in a dry run), names dismissed, conflicts left open and
    edits or picks that came to nothing, and a line on each."""

    fixed: int = 0
    suppressed: int = 0
    left: int = 0
    skipped: int = 0
    messages: list[str] = field(default_factory=list)

    def line(self) -> str:
        return f"edits {self.fixed}, dismissed {self.suppressed}, open {self.left}, nothing done {self.skipped}"


def settle(numbered: DataFrame, signatures: dict[int, tuple[str, str]], answer: str, lines: DataFrame, log: Callable[..., None] | None = None, suppress: Callable[[str, str], None] | None = None, confirm: bool = False) -> Settled:
    """Apply picks to one page (at most CONFLICT_PAGE conflicts): keep a value and rewrite the
    others, or dismiss a name with suppress(name, signature), or leave it.
    numbered: choices() with all sources; signatures: index -> (name, signature)."""
    picks, rest = parse_picks(answer)
    out = Settled(skipped=len(rest), messages=[f"{word}: a pick is two numbers, conflict:choice" for word in rest])
    sizes = dict(numbered.groupBy("index").agg(F.max("choice")).collect())
    note = log if log and confirm else lambda *_: None
    keep = []
    for pick in picks:
        size = sizes.get(pick.index) if pick.index in signatures else None
        beyond = pick.choice - (size or 0)
        if size is None or pick.choice < 1 or beyond > 2:
            out.skipped += 1
            out.messages.append(f"{pick.index}:{pick.choice}: not on this page")
        elif beyond == 2:
            out.left += 1
        elif beyond == 1:
            out.suppressed += 1
            note("dismissed", *signatures[pick.index])
            if confirm and suppress:
                suppress(*signatures[pick.index])
        else:
            keep.append((pick.index, pick.choice))
    if keep:
        wanted = picked(numbered, numbered.sparkSession.createDataFrame(keep, "index int, choice int"))
        found = plan(wanted, lines)
        edits = [Edit(r["name"], r["file"], r["line"], r["rx"], r["new_text"]) for r in found.collect()]
        lost = wanted.select("index", "file", "number", "unit").distinct().join(found, ["index", "file", "number", "unit"], "left_anti")
        missing = lost.orderBy("file", "number").collect()
        out.messages += [f"{r['file']}: {r['number']:g} {r['unit']} is not in it" for r in missing]
        out.skipped += len(missing)
        for edit, done, what in apply(edits, confirm):
            out.fixed, out.skipped = out.fixed + done, out.skipped + (not done)
            change = f"{what} -> {edit.new_text}" if done else what
            out.messages.append(f"{edit.file}:{edit.line}: {change}")
            if done:
                note("edited", edit.name, f"{edit.file}:{edit.line}", change)
    return out


def stamp() -> str:
    return datetime.now().strftime("%Y-%m-%d %H:%M")


def render(numbered: DataFrame, total: int, size: int = CONFLICT_PAGE, shown: int = 2) -> str:
    """A page of conflicts as text: values by number, and the two choices after them."""
    rows = [r.asDict() for r in numbered.orderBy("index", "choice").collect()]
    out = [f"open conflicts: {total}" + (f", of which the first {size}" if total > size else "")]
    for index, own in groupby(rows, key=lambda r: r["index"]):
        own = list(own)
        out.append(f"[{index}] {own[0]['name']}")
        for r in own:
            more = r["n_sources"] - min(shown, r["n_sources"])
            out.append(f"    {index}:{r['choice']}  {r['number']:g} {r['unit']}  in {' '.join(r['sources'][:shown])}" + (f" (+{more})" if more else ""))
        out.append(f"    {index}:{len(own) + 1}  they may differ    {index}:{len(own) + 2}  later")
    return "\n".join(out)
