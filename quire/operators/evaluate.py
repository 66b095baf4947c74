"""Scores of results: invariants, distances to a truth, terminology, upserts of benchmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.functions import text as T
from quire.functions.slices import by_row
from quire.operators import masking
from quire.operators.merge import SEPARATOR

# What a translation must hold as often as its source.
COUNTED = {"pages": SEPARATOR, "inline_math": "\\(", "display_math": "\\[", "images": "![", "cells": "<td", "tables": "<table"}


def invariants(pairs: DataFrame) -> DataFrame:
    """(doc_id, source, result): one row for each count that must agree; na where the source has none."""
    checks = [F.struct(F.lit(n).alias("name"), T.occurrences(F.col("source"), x).alias("expected"), T.occurrences(F.col("result"), x).alias("found")) for n, x in COUNTED.items()]
    residue = F.struct(F.lit("placeholders").alias("name"), F.lit(0).cast("long").alias("expected"), F.regexp_count("result", F.lit(r"<[mkgucft]\d+")).cast("long").alias("found"))
    rows = pairs.select("doc_id", F.explode(F.array(*checks, residue)).alias("c")).select("doc_id", "c.*")
    return rows.withColumn("ok", F.col("expected") == F.col("found")).withColumn("na", (F.col("expected") == 0) & (F.col("found") == 0))


# Rows of the table of distances that are bits of one number at a time.
ROWS = 1 << 15


def _alike(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def distance(a: str, b: str, rows: int = ROWS) -> int:
    """Levenshtein distance of two whole texts of any length: what they begin or end with alike costs nothing; of the table between, a column of so many rows is one step (Myers' bit vectors), and only a row of differences goes on to the rows below."""
    if len(a) > len(b):
        a, b = b, a
    n = _alike(a, b)
    a, b = a[n:], b[n:]
    n = _alike(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    across = [1] * len(b)
    for at in range(0, len(a), rows):
        part, met = a[at : at + rows], {}
        for i, c in enumerate(part):
            met[c] = met.get(c, 0) | 1 << i
        mask, last = (1 << len(part)) - 1, 1 << (len(part) - 1)
        up, down = mask, 0
        for j, c in enumerate(b):
            above, same = across[j], met.get(c, 0)
            either = same | down
            if above < 0:
                same |= 1
            flat = ((same & up) + up ^ up) | same
            more, less = (down | ~(flat | up)) & mask, up & flat
            across[j] = 1 if more & last else -1 if less & last else 0
            more, less = (more << 1 | (above > 0)) & mask, (less << 1 | (above < 0)) & mask
            up, down = (less | ~(either | more)) & mask, more & either
    return len(a) + sum(across)


@by_row(IntegerType())
def _distance(a: str | None, b: str | None, rows: int) -> int | None:
    return None if a is None or b is None else distance(a, b, rows)


def edit_distance(a: Column, b: Column, rows: int = ROWS) -> Column:
    """distance() of two texts; null where one is."""
    return _distance(a, b, F.lit(rows))


def _plain(c: Column) -> Column:
    """Markdown without images and extra white space."""
    return T.squeeze(F.regexp_replace(c, r"!\[\]\([^)]*\)", ""))


def ground_truth(result: Column, truth: Column) -> tuple[Column, Column]:
    """(edit distance, longest length) of two whole Markdown texts without images and extra white space."""
    a, b = _plain(result), _plain(truth)
    return edit_distance(a, b), F.greatest(F.length(a), F.length(b))


def truth_metrics(result: Column, truth: Column) -> dict[str, Column]:
    """distance and cer (edit distance over the longer and over the true text), and how far tables, formulas and figures agree in number."""
    far, longest = ground_truth(result, truth)
    true = F.length(_plain(truth))
    a, b = T.structure_counts(result), T.structure_counts(truth)
    ratio = lambda n: F.when(F.greatest(a[n], b[n]) > 0, F.round(F.least(a[n], b[n]) / F.greatest(a[n], b[n]), 3)).otherwise(1.0)
    return {"distance": F.round(far / F.greatest(longest, F.lit(1)), 4), "cer": F.round(far / F.greatest(true, F.lit(1)), 4), **{n: ratio(n) for n in ("tables", "formulas", "figures")}}


def violating(hits: DataFrame) -> DataFrame:
    """Of hits with the text of their unit, those whose entry is not, as it should be, in that text: the target of terms, the name itself of names."""
    bad = F.when(F.col("policy") == "A", ~F.lower("text").contains(F.lower("ko"))).otherwise(~F.col("text").contains(F.col("ko")))
    return hits.filter(bad).select("doc_id", "unit_id", "src", "ko", "policy")


def violations(hits: DataFrame, units: DataFrame) -> DataFrame:
    """violating() for hits that come without texts."""
    return violating(hits.join(units.select("doc_id", "unit_id", "text"), ["doc_id", "unit_id"]))


def layout_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Blocks of two layouts, by page and number, that differ in more than their content."""
    old = before.select("doc_id", "page", "block_no", F.col("type").alias("t"), F.col("bbox").alias("b"))
    return old.join(after, ["doc_id", "page", "block_no"]).filter(~(F.col("t").eqNullSafe(F.col("type")) & F.col("b").eqNullSafe(F.col("bbox")))).select("doc_id", "page", "block_no")


def upsert(rows: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(recency)))).filter("nth = 1").drop("nth")


def replayed(units: DataFrame, keyed: DataFrame, cache: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, unit_id, src, text, status of all units: 'found' in the cache by their keys, 'skipped', 'kept' where kept (doc_id, unit_id) lists them, else 'unverified'."""
    keys = [c for c in ("ask", "key", "src") if c in cache.columns]
    known = cache.groupBy(*keys).agg(F.min("text").alias("text"))
    found = keyed.select("doc_id", "unit_id", *keys).join(known, keys, "left").select("doc_id", "unit_id", "text")
    rows = units.select("doc_id", "unit_id", "src", "reason").join(found, ["doc_id", "unit_id"], "left").join(kept.select("doc_id", "unit_id", F.lit(True).alias("listed")).distinct(), ["doc_id", "unit_id"], "left")
    status = F.when(F.col("reason") != "", "skipped").when(F.col("text").isNotNull(), "found").when(F.col("listed"), "kept").otherwise("unverified")
    return rows.select("doc_id", "unit_id", "src", F.when(status == "found", F.col("text")).alias("text"), status.alias("status"))


def evaluation(pairs: DataFrame, outcome: DataFrame, replay: DataFrame, hits: DataFrame, ending: str, layouts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row for each document of pairs (doc_id, source, result): hard checks, what the run did, and the quality of what is found again.

    passed of checks says how many invariants hold of those that apply, hard_ok whether all do; the layouts before and
    after add two, their numbers of blocks and all their fields but content. outcome is that of the run, replay that of
    replayed(), hits where entries of the glossary occur. Units that are not found again count for nothing in the quality.
    """
    checks = invariants(pairs).filter("not na").select("doc_id", "ok")
    if layouts is not None:
        before, after = layouts
        sizes = before.groupBy("doc_id").agg(F.count("*").alias("a")).join(after.groupBy("doc_id").agg(F.count("*").alias("b")), "doc_id", "full").select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))
        moved = layout_diff(before, after).select("doc_id", F.lit(True).alias("moved")).distinct()
        fields = before.select("doc_id").distinct().join(moved, "doc_id", "left").select("doc_id", F.col("moved").isNull().alias("ok"))
        checks = checks.unionByName(sizes).unionByName(fields)
    hard = checks.groupBy("doc_id").agg(F.count_if("ok").alias("passed"), F.count("*").alias("checks"))
    status = lambda s: F.count_if(F.col("status") == s)
    done = outcome.groupBy("doc_id").agg(*[status(s).alias(s) for s in ("translated", "cached", "kept", "skipped")], *[F.sum(c).alias(c) for c in ("retried", "repaired", "split", "sanitized")])
    found = replay.withColumn("plain", masking.residual_text(F.col("text")))
    hangul, solid = masking.hangul_share(F.col("plain"))
    quality = found.groupBy("doc_id").agg(status("found").alias("found"), status("unverified").alias("unverified"), F.coalesce(F.sum(hangul), F.lit(0)).alias("hangul"), F.coalesce(F.sum(solid), F.lit(0)).alias("solid"), F.coalesce(F.sum(F.regexp_count("text", F.lit(ending))), F.lit(0)).cast("long").alias("endings"))
    bad = violations(hits, replay.filter("status = 'found'")).groupBy("doc_id").agg(F.count("*").alias("violations"))
    out = pairs.select("doc_id").join(hard, "doc_id", "left").join(done, "doc_id", "left").join(quality, "doc_id", "left").join(bad, "doc_id", "left")
    ratio = F.when(F.col("solid") > 0, F.col("hangul") / F.col("solid")).otherwise(0.0)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "doc_id"]
    total = F.coalesce(F.col("translated") + F.col("cached") + F.col("kept"), F.lit(0)).cast("long")
    return out.select("doc_id", *counts, total.alias("total"), F.coalesce(F.col("passed") == F.col("checks"), F.lit(True)).alias("hard_ok"), F.coalesce(F.round(ratio, 6), F.lit(0.0)).alias("hangul_ratio"))


#: Violations that a summary shows one by one.
SHOWN = 12


def summary(report: DataFrame, bad: DataFrame, most: int = SHOWN) -> DataFrame:
    """doc_id, summary: what a person reads of evaluation() and of violations(): the verdict, what the run did, the quality, and the first violations by entry and unit."""
    first = F.array_sort(F.collect_list(F.struct("src", "unit_id", "ko", "policy")))
    shown = bad.groupBy("doc_id").agg(F.count("*").alias("n"), F.transform(F.slice(first, 1, most), lambda v: F.concat(F.lit("- ["), v["policy"], F.lit("] "), v["unit_id"], F.lit(" "), v["src"], F.lit(" -> "), v["ko"])).alias("shown"))
    counts = lambda *names: F.concat_ws(", ", *[F.concat(F.lit(f"{n} "), F.col(n).cast("string")) for n in names])
    rows = report.join(shown, "doc_id", "left")
    verdict = F.concat(F.when(F.col("hard_ok"), "PASS ").otherwise("FAIL "), F.col("passed").cast("string"), F.lit("/"), F.col("checks").cast("string"))
    n = F.coalesce("n", F.lit(0))
    said = F.concat_ws(
        "\n", verdict, counts("total", "translated", "cached", "kept", "skipped", "retried", "repaired", "split", "sanitized"), counts("found", "unverified", "endings"), F.format_string("hangul %.1f %%", F.col("hangul_ratio") * 100),
        F.concat(F.lit("violations "), n.cast("string")), F.array_join("shown", "\n"), F.when(n > most, F.concat(F.lit("... "), (n - most).cast("string"), F.lit(" more"))),
    )
    return rows.select("doc_id", said.alias("summary"))
