"""What becomes of pages whose reading fails or runs away: retries, pages one by one, the text layer, a placeholder; with warnings as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as T
from quire.operators import merge
from quire.streaming.detector import Detector

# What stands for a page that could not be had, and how much of an error a warning shows.
FAILED, SHOWN = "> ⚠️ 이 페이지는 변환에 실패했습니다", 200


@F.pandas_udf(StringType())
def runaway(text: pd.Series, expected: pd.Series) -> pd.Series:
    """Why the detector stops a whole text of so many pages ('' if it doesn't); null for null."""

    def reason(t: str | None, n: int) -> str | None:
        if t is None:
            return None
        own = Detector(int(n))
        own.feed(t, end=True)
        return own.reason

    return pd.Series([reason(t, n) for t, n in zip(text, expected)], index=text.index, dtype=object)


def tried(attempts: DataFrame, keys: list[str], expected: Column) -> DataFrame:
    """attempts (keys, attempt 1 or 2, text or null, error) to one row each: text of the attempt that counts, loop (why it ran away) or error of the last one that counts.

    A first attempt that fails is made once more; one that runs away is not, as it would again.
    """
    rows = attempts.withColumn("loop", runaway("text", expected))
    both = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("attempt") == n, F.struct("text", "loop", "error"))).alias(f"a{n}") for n in (1, 2)])
    counts = F.when(F.col("a1.text").isNotNull(), F.col("a1")).otherwise(F.coalesce("a2", "a1"))
    told = both.select(*keys, counts.alias("a"))
    good = F.coalesce(F.col("a.loop") == "", F.lit(False))
    return told.select(*keys, F.when(good, F.col("a.text")).alias("text"), F.when(F.col("a.loop") != "", F.col("a.loop")).alias("loop"), F.when(F.col("a.text").isNull(), F.coalesce("a.error", F.lit(""))).alias("error"))


def routed(chunks: DataFrame, multi: DataFrame, single: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, warnings) of chunks (doc_id, chunk, first_page, num_pages, single: whether pages are read one by one anyway).

    multi (doc_id, chunk, attempt, text, error) are the attempts at whole chunks, single (doc_id, page, attempt, text,
    error) those at pages, layers (doc_id, page, text) the text layers. Pages are doc_id, page, md, source: 'multi',
    'single', 'text_layer' or 'placeholder'. Warnings are doc_id, first_page, last_page, kind ('reread', 'text_layer',
    'placeholder'), detail. Pages of a chunk that ran away are read one by one; those of one that failed twice are
    given up together; a page of its own that can't be had is what its text layer holds.
    """
    last = F.col("first_page") + F.col("num_pages") - 1
    held = chunks.join(tried(multi.join(chunks.select("doc_id", "chunk", "num_pages"), ["doc_id", "chunk"]), ["doc_id", "chunk"], F.col("num_pages")), ["doc_id", "chunk"], "left")
    loop = F.coalesce("loop", F.lit(""))
    apart = held.filter((loop != "") | F.col("single")).select("doc_id", "single", loop.alias("loop"), "first_page", "num_pages")
    whole = held.filter((loop == "") & ~F.col("single"))
    read = merge.chunk_pages(whole.filter("text is not null").select("doc_id", "chunk", "first_page", "num_pages", "single", F.col("text").alias("markdown")))
    read = read.select("doc_id", "page", "md", F.lit("multi").alias("source"))

    given_up = whole.filter("text is null").select("doc_id", "first_page", last.alias("last_page"), F.coalesce("error", F.lit("")).alias("error"))
    lost = given_up.select("doc_id", F.explode(F.sequence("first_page", "last_page")).alias("page")).select("doc_id", "page", F.lit(FAILED).alias("md"), F.lit("placeholder").alias("source"))

    pages = apart.select("doc_id", F.explode(F.sequence("first_page", last)).alias("page"))
    got = pages.join(tried(single, ["doc_id", "page"], F.lit(1)), ["doc_id", "page"], "left").join(layers.select("doc_id", "page", T.inert_markdown(F.col("text")).alias("layer")), ["doc_id", "page"], "left")
    source = F.when(F.col("text").isNotNull(), "single").when(F.col("layer").isNotNull(), "text_layer").otherwise("placeholder")
    got = got.withColumn("source", source).withColumn("detail", F.left(F.coalesce("loop", "error", F.lit("")), F.lit(SHOWN)))
    alone = got.select("doc_id", "page", F.coalesce(T.strip(F.col("text")), "layer", F.lit(FAILED)).alias("md"), "source")

    said = lambda df, first, last_, kind, detail: df.select("doc_id", F.col(first).alias("first_page"), F.col(last_).alias("last_page") if isinstance(last_, str) else last_.alias("last_page"), kind.alias("kind"), F.left(F.col(detail), F.lit(SHOWN)).alias("detail"))
    warnings = said(apart.filter("not single"), "first_page", last, F.lit("reread"), "loop")
    warnings = warnings.unionByName(said(given_up, "first_page", "last_page", F.lit("placeholder"), "error"))
    warnings = warnings.unionByName(said(got.filter("source <> 'single'"), "page", "page", F.col("source"), "detail"))
    return read.unionByName(lost).unionByName(alone), warnings

