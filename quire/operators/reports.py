"""Small reports and settings: warnings, samples for a judge, its averages, committed pages, budgets, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens that a reply may have, by how much a model may think.
OUTPUT_TOKENS = {"": 8192, "off": 8192, "low": 10240, "medium": 20480, "high": 40960, "xhigh": 81920}


def output_tokens(effort: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in OUTPUT_TOKENS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.coalesce(effort, F.lit(""))), F.lit(OUTPUT_TOKENS[""]))


def base_url(c: Column) -> Column:
    """Without blanks and slashes at the end, and without an empty port."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "/+$", ""), "^(https?://[^/]+?):(?=/|$)", "$1")


def first_seen(warnings: Column, most: int = 40) -> Column:
    """Distinct warnings in their order, up to a number."""
    return F.slice(F.array_distinct(warnings), 1, most)


def with_provider(own: Column, provider: Column) -> Column:
    """A page's warnings, then those of its provider that are not among them."""
    return F.concat(own, F.filter(provider, lambda w: ~F.array_contains(own, w)))


def histogram(rows: DataFrame, by: str, most: int = 3) -> DataFrame:
    """The most frequent values with their numbers, ties by value."""
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(most)


def committed(raw: Column) -> tuple[Column, Column]:
    """(pages that another page follows, the unfinished rest) of a stream's text."""
    parts = F.split(raw, "<PAGE>", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)


def judge_sample(units: DataFrame, size: int = 12, longest: int = 4, seed: int = 1234) -> DataFrame:
    """(doc_id, unit_id, src): of each document the longest units, and others by the order of a seeded hash."""
    by_length = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("src")), "unit_id"))
    rows = units.withColumn("long", by_length <= longest)
    by_hash = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("long"), F.md5(F.concat_ws(":", "unit_id", F.lit(seed).cast("string"))), "unit_id"))
    return rows.withColumn("place", by_hash).filter(F.col("place") <= size).drop("place")


def judge_averages(scores: DataFrame, names: list[str]) -> DataFrame:
    """Averages of each document's scores to two decimals, ties to even, nulls left out; omissions counted, errors joined."""
    means = [F.bround(F.avg(n), 2).alias(f"avg_{n}") for n in names]
    errors = F.array_sort(F.flatten(F.collect_list(F.coalesce("errors", F.array().cast("array<string>"))))).alias("errors")
    return scores.groupBy("doc_id").agg(F.count("*").alias("judged"), *means, F.count_if("omission").alias("omissions"), errors)


def endings(units: DataFrame, pattern: str) -> DataFrame:
    """doc_id, n, unit_ids: occurrences of an ending, and the units that hold one."""
    rows = units.withColumn("hits", F.regexp_count("text", F.lit(pattern))).filter("hits > 0")
    return rows.groupBy("doc_id").agg(F.sum("hits").cast("long").alias("n"), F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))


def prompt(text: Column, pairs: Column, keep: Column, context: Column) -> Column:
    """The parts of a request that a unit has: context, terms, names to keep, text."""
    some = lambda c, head, body: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(head), body))
    terms = F.array_join(F.transform(pairs, lambda p: F.concat(p["src"], F.lit(" = "), p["ko"])), "\n")
    before = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Before:\n"), context))
    return F.concat_ws("\n\n", before, some(pairs, "Terms:\n", terms), some(keep, "Keep: ", F.array_join(keep, ", ")), F.concat(F.lit("Text:\n"), text))
