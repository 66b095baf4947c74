"""What callers are shown of jobs: their records, texts and translations, and what goes with a job that is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import jobs as J

IMAGES = r"(?i)\.(?:jpg|jpeg|png)\z"
FOLDERS = ("images", "layout", "pages")


def records(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs (id, status, created_at, …) with what only finished ones have, and the place of those that wait.

    files (id, folder, name) are the artifacts: image files of the known folders become sorted URLs, has_layout says
    whether the job's own folder ('') holds layout.json. All result columns are null unless the job is done,
    queue_position is null unless it is queued.
    """
    url = F.concat(F.lit("/api/jobs/"), F.col("id").cast("string"))
    names = lambda d: F.array_sort(F.collect_list(F.when((F.col("folder") == d) & F.col("name").rlike(IMAGES), F.col("name"))))
    own = files.groupBy("id").agg(*[names(d).alias(f"f_{d}") for d in FOLDERS], F.max((F.col("folder") == "") & (F.col("name") == "layout.json")).alias("layout_json"))
    places = J.queue_positions(jobs).select("id", F.col("position").alias("queue_position"))
    done = F.col("status") == "done"

    def urls(folder: str) -> Column:
        return F.when(done, F.transform(F.coalesce(f"f_{folder}", F.array().cast("array<string>")), lambda n: F.concat(url, F.lit(f"/files/{folder}/"), n)))

    parts = [F.when(done, F.concat(url, F.lit(f"/{p}"))).alias(f"{p}_url") for p in ("markdown", "html", "archive")]
    rows = jobs.join(own, "id", "left").join(places, "id", "left")
    files_of = [urls(d).alias(c) for d, c in zip(FOLDERS, ("images", "layouts", "pages"), strict=True)]
    return rows.select(*jobs.columns, *parts, *files_of, F.when(done, F.coalesce("layout_json", F.lit(False))).alias("has_layout"), "queue_position")


def shown_text(jobs: DataFrame, texts: DataFrame, translations: DataFrame, lang: str | None = None) -> DataFrame:
    """id, text, partial, found: a job's Markdown, or its translation into lang; partial until the job is done, found is false where there is none."""
    own = texts.select("id", "text") if lang is None else translations.filter(F.col("lang") == lang).select("id", "text")
    return jobs.join(own, "id", "left").select("id", "text", (F.col("status") != "done").alias("partial"), F.col("text").isNotNull().alias("found"))


def deleted(jobs: DataFrame, tasks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs that stay, running translations (id, lang) that must stop) when those in wanted (id) are deleted: a running job stays until its worker sees it, marked."""
    gone = wanted.select("id", F.lit(True).alias("delete_requested")).distinct()
    marked = jobs.join(gone, "id", "left").withColumn("delete_requested", F.coalesce("delete_requested", F.lit(False)))
    return marked.filter(~F.col("delete_requested") | (F.col("status") == "running")), tasks.join(gone.select("id"), "id", "left_semi")


def settled(states: DataFrame, alive: DataFrame) -> DataFrame:
    """Translation states (id, lang, status): those said to run that no task in alive (id, lang) runs have failed."""
    own = alive.select("id", "lang", F.lit(True).alias("live")).distinct()
    rows = states.join(own, ["id", "lang"], "left")
    return rows.withColumn("status", F.when((F.col("status") == "running") & F.col("live").isNull(), "error").otherwise(F.col("status"))).drop("live")


def all_failed(pages: DataFrame) -> DataFrame:
    """doc_id, failed: whether no page (doc_id, failed) came through."""
    return pages.groupBy("doc_id").agg(F.bool_and("failed").alias("failed"))


def retry_delay(attempt: Column) -> Column:
    """Milliseconds until a lost stream is tried again: ten seconds more each time, up to thirty."""
    return F.least(F.lit(30_000), (F.coalesce(attempt, F.lit(0)) + 1) * 10_000)


def resynced(number: Column, page: Column, announced: Column) -> Column:
    """The divider that the next marker follows: the announced page's own marker is still to come, others move on; never back."""
    return F.greatest(F.coalesce(number, F.lit(0)), F.when(announced, page - 1).otherwise(page))


def throughput(runs: DataFrame) -> DataFrame:
    """Runs (engine, document, pages, seconds) with pages_per_s and avg_page_s."""
    per = F.when(F.col("seconds") > 0, F.round(F.col("pages") / F.col("seconds"), 3)).otherwise(0.0)
    return runs.withColumn("pages_per_s", per).withColumn("avg_page_s", F.round(F.col("seconds") / F.greatest("pages", F.lit(1)), 1))
