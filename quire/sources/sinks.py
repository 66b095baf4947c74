"""Writers; Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents (doc_id, markdown), one folder for each range of ids."""
    documents.withColumn("bucket", F.floor(F.col("doc_id") / 1000)).write.mode(mode).partitionBy("bucket").json(path)


def layouts(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON line for each document: its pages with their blocks in order."""
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_no", "type", "bbox", "content"))).alias("blocks"))
    pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages")).write.mode(mode).json(path)


def benchmark(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Benchmark rows as CSV with a header, by document and engine."""
    rows.orderBy("document", "engine").write.mode(mode).option("header", True).csv(path)


#: Folders of an archive, whatever the number of its documents.
BUCKETS = 64


def _bucket(doc_id):
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(BUCKETS)).cast("int")


def archive(artifacts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Artifacts (doc_id, folder, name, content) packed by documents' hashes, sorted by document, so that files' statistics tell where one lies; names that would leave their folder are refused."""
    kept = artifacts.filter(safe_path(F.col("name")) & ((F.col("folder") == "") | safe_path(F.col("folder")))).withColumn("bucket", _bucket(F.col("doc_id")))
    kept.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "doc_id", "folder", "name").write.mode(mode).partitionBy("bucket").parquet(path)


def entries(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """folder, name, content of one document of an archive, in order: one bucket is looked into."""
    bucket = spark.range(1).select(_bucket(F.lit(doc_id))).first()[0]
    return spark.read.parquet(path).filter((F.col("bucket") == bucket) & (F.col("doc_id") == doc_id)).select("folder", "name", "content").orderBy("folder", "name")


def summary(rows: DataFrame) -> str:
    """Benchmark rows, a few dozen, as a Markdown table by document and engine."""
    cols = ["engine", "model", "document", "pages", "total_s", "avg_page_s", "md_chars", "tables", "formulas", "figures", "warnings"]
    own = [c for c in cols if c in rows.columns]
    said = [" | ".join("-" if r[c] is None else str(r[c]) for c in own) for r in rows.orderBy("document", "engine").select(own).collect()]
    return "\n".join(["| " + " | ".join(own) + " |", "|" + "---|" * len(own), *(f"| {x} |" for x in said)]) + "\n"


def safe_path(c):
    """Whether a relative path stays in its folder."""
    return ~c.rlike(r"(^|/)\.\.(/|\z)|^/|\\|\x00") & (c != "")
