"""Runaway repetition in pages: line templates, counters, tandem repeats, budgets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quire.functions import text as T
from quire.functions.slices import by_row

# Thresholds of the detector.
LINE_RUN, PAGE_CHARS, PAGE_TOKENS = 64, 16_384, 6_144
TEMPLATE_CHARS, LETTERS, NUMBER_FIELDS = 24, 8, 2
ROLLING_CHARS, UNIT_ATOMS, REPEATS, SPAN_CHARS, COUNTER_RUN, COUNTER_LETTERS = 4_096, 64, 24, 3_072, 20, 0.05
LAYOUT = r"(?is)<\|(?:ref|det)\|>.*?<\|/(?:ref|det)\|>"


def templates(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, template): blank lines are left out; a line that can't be part of a run has a null template."""
    rows = pages.select("doc_id", "page", F.posexplode(T.lines(F.regexp_replace("text", "\r\n?", "\n"))).alias("line_no", "line"))
    compact = T.folded(T.squeeze(F.regexp_replace("line", LAYOUT, "")))
    rows = rows.withColumn("compact", compact).filter("compact <> ''")
    fields = F.regexp_count("compact", F.lit(r"\d+"))
    shape = F.regexp_replace("compact", r"\d+", "<n>")
    ok = fields.between(1, NUMBER_FIELDS) & (F.length(shape) >= TEMPLATE_CHARS) & (F.length(F.regexp_replace(shape, r"[^\p{L}]", "")) >= LETTERS)
    return rows.select("doc_id", "page", "line_no", F.when(ok, shape).alias("template"))


def line_runs(pages: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` lines of one template: (doc_id, page, first_line, n, template)."""
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    rows = templates(pages)
    change = (~F.col("template").eqNullSafe(F.lag("template").over(page))) | F.col("template").isNull()
    rows = rows.withColumn("run", F.sum(change.cast("int")).over(page)).filter("template is not null")
    return rows.groupBy("doc_id", "page", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"), F.first("template").alias("template")).filter(F.col("n") >= least).drop("run")


COUNTER = r"#\s*(\d{1,7})\s*\."


def counter_runs(pages: DataFrame, least: int = COUNTER_RUN, letters: float = COUNTER_LETTERS) -> DataFrame:
    """Runs of '#n.' whose numbers go up by one, in the last part of a page, with hardly any letters between them: (doc_id, page, first, n)."""
    tail = F.regexp_replace(F.right(F.col("text"), F.lit(ROLLING_CHARS)), LAYOUT, "")
    at = pages.select("doc_id", "page", F.split(tail, COUNTER, -1).alias("gaps"), F.regexp_extract_all(tail, F.lit(COUNTER), F.lit(0)).alias("marks"))
    found = at.select("doc_id", "page", F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("marks")).alias("gap"), F.col("marks").alias("mark"))).alias("i", "c"))
    rows = found.select("doc_id", "page", "i", F.regexp_extract("c.mark", COUNTER, 1).cast("int").alias("v"), F.length("c.mark").alias("n_mark"), F.length("c.gap").alias("n_gap"), F.length(F.regexp_replace("c.gap", r"[^\p{L}]", "")).alias("n_letters"))
    # numbers that go up by one with their place have one difference: an island; a run begins where it changes
    page = Window.partitionBy("doc_id", "page").orderBy("i")
    island = F.col("v") - F.col("i")
    new = ~island.eqNullSafe(F.lag(island).over(page))
    rows = rows.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(page))
    inner = lambda c: F.sum(F.when(~F.col("new"), F.col(c)).otherwise(0))  # noqa: E731  the gap before a run is none of its own
    runs = rows.groupBy("doc_id", "page", "run").agg(F.min("v").alias("first"), F.count("*").alias("n"), inner("n_letters").alias("alpha"), (F.sum("n_mark") + inner("n_gap")).alias("span"))
    return runs.filter((F.col("n") >= least) & (F.col("alpha") <= F.col("span") * letters)).select("doc_id", "page", "first", "n")


def page_budget(pages: DataFrame, chars: int = PAGE_CHARS) -> DataFrame:
    return pages.select("doc_id", "page", F.length("text").cast("long").alias("n_chars"), (F.length("text") > chars).alias("over"))


def page_flood(markers: Column, expected: Column) -> Column:
    return markers > F.greatest(expected + 2, expected * 2)


_NUMBER, _LAYOUT = re.compile(r"\d+"), re.compile(LAYOUT)


def template(line: str) -> str | None:
    """The template of one line, as templates() has it: '' for a blank line, None for one that can't be part of a run."""
    compact = " ".join(_LAYOUT.sub("", line).split()).casefold()
    shape, n = _NUMBER.subn("<n>", compact)
    fits = 1 <= n <= NUMBER_FIELDS and len(shape) >= TEMPLATE_CHARS and sum(map(str.isalpha, shape)) >= LETTERS
    return "" if not compact else shape if fits else None


_ATOM = re.compile(r"\w+|[^\w\s]")


def tandem(text: str) -> tuple[int, str] | None:
    """(repeats, unit) of the shortest unit of atoms that the unfinished last line repeats at its end."""
    atoms = _ATOM.findall(text[text.rfind("\n") + 1 :])
    for size in range(1, min(UNIT_ATOMS, len(atoms) // REPEATS) + 1):
        unit = atoms[len(atoms) - size :]
        whole = "".join(unit)
        if "|" in unit or not any(map(str.isalnum, whole)) or not (any(map(str.isalpha, whole)) or any(a != "_" and not a.isalnum() for a in unit)):
            continue
        same = 0  # atoms at the end that equal the one a unit before
        while same + size < len(atoms) and atoms[-1 - same] == atoms[-1 - same - size]:
            same += 1
        n = same // size + 1
        if n >= REPEATS and len(" ".join(atoms[len(atoms) - n * size :])) >= SPAN_CHARS:
            return n, " ".join(unit)[:160]
    return None


@F.pandas_udf(StructType([StructField("repeats", IntegerType()), StructField("unit", StringType())]))
def tandem_repeat(text: pd.Series) -> pd.DataFrame:
    found = [tandem(_LAYOUT.sub("", (t or "")[-ROLLING_CHARS:])) for t in text]
    return pd.DataFrame({"repeats": [f[0] if f else 0 for f in found], "unit": [f[1] if f else None for f in found]})


def without_suffix_repeats(text: str, least: int = 8000, periods: int = 200, chars: int = 100, times: int = 5) -> str:
    """A long text whose end repeats itself, cut to one period and the unfinished part after the last."""
    n = len(text)
    if n < least:
        return text
    for period in range(1, min(periods, n - 1) + 1):
        same = 0
        while same + period < n and text[n - 1 - same] == text[n - 1 - same - period]:
            same += 1
        if same:
            total = same + period
            if total // period >= times and total >= chars:
                return text[: n - same] + text[n - total % period :]
    return text


@by_row(StringType())
def clean_suffix(text: str | None) -> str | None:
    return None if text is None else without_suffix_repeats(text)


def ngram_bans(sequence: Column, size: int, window: int) -> Column:
    """Sorted distinct tokens that would complete an n-gram already seen in the last `window` tokens."""
    last = lambda seq: F.when(F.size(seq) > window, F.slice(seq, F.size(seq) - window + 1, window)).otherwise(seq)

    def banned(seq: Column) -> Column:
        starts = F.when(F.size(seq) >= size, F.sequence(F.lit(1), F.size(seq) - size + 1)).otherwise(F.array().cast("array<int>"))
        hits = T.let(F.slice(seq, F.greatest(F.size(seq) - size + 2, F.lit(1)), size - 1), lambda tail: F.filter(starts, lambda i: F.slice(seq, i, size - 1) == tail))
        return F.array_sort(F.array_distinct(F.transform(hits, lambda i: F.element_at(seq, i + size - 1))))

    return T.let(T.let(sequence, last), banned)
