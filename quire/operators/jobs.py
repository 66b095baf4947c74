"""The job table: newest, queue places, expiry, restarts, cancellation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "error", "cancelled")


def newest(jobs: DataFrame, n: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def queue_positions(jobs: DataFrame, by: str = "created_at") -> DataFrame:
    """Queued jobs with their place in the one line, by time of creation and id.

    Each hour's jobs are numbered on their own and shifted by the counts of the hours before, so that only these
    counts, one row for each hour, come together in one place.
    """
    queued = jobs.filter("status = 'queued'").withColumn("hour", F.floor(F.col(by).cast("timestamp").cast("double") / 3600).cast("long"))
    sums = queued.groupBy("hour").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("hour", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("hour").orderBy(by, "id"))
    return queued.withColumn("own", own).join(sums, "hour").withColumn("position", F.col("ahead") + F.col("own")).drop("hour", "own", "ahead")


def expired(jobs: DataFrame, cutoff: Column, protected: DataFrame) -> DataFrame:
    """Finished jobs last touched before the cutoff that nothing protects; touched is the later of a job's and its translation's."""
    touched = F.greatest("updated_at", F.coalesce("translated_at", "updated_at"))
    return jobs.filter(F.col("status").isin(*TERMINAL) & (touched < cutoff)).join(protected, "id", "left_anti")


def restarted(jobs: DataFrame) -> DataFrame:
    """What a restart leaves: jobs that were under way have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "error").otherwise(F.col("status")))


def cancelled(status: Column) -> Column:
    return F.when(status.isin(*TERMINAL), status).otherwise("cancelled")


def backoff(n: Column, retry_after: Column | None = None) -> Column:
    wait = F.least(F.lit(30.0), F.pow(F.lit(3.0), n))
    return wait if retry_after is None else F.coalesce(retry_after, wait)
