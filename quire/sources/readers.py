"""Readers: uploads, JSON artifacts, event captures, provider responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas


@dataclass(frozen=True)
class Limits:
    """Limits of an upload; 0 or less switches one off."""

    max_bytes: int = 100 << 20
    max_pages: int = 0
    max_side_pt: float = 5400.0
    modes: tuple[str, ...] = ("multi", "per_page")
    dpi: tuple[int, int] = (72, 400)


def uploads(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """binaryFile rows (path, length, content, mode, dpi) with the reason for which each is refused; null if it is taken."""
    size = F.col("length")
    reason = (
        F.when(~F.col("mode").isin(*limits.modes), "mode").when(~F.col("dpi").between(*limits.dpi), "dpi").when(~F.lower("path").endswith(".pdf"), "name").when(size <= 0, "empty")
        .when((size > limits.max_bytes) & F.lit(limits.max_bytes > 0), "size").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "magic")
    )
    return files.withColumn("refused", reason)


def probe(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_pages, ok of (doc_id, w_pt, h_pt): at least one page, not too many, none too large."""
    n, side = F.count("*"), F.max(F.greatest("w_pt", "h_pt"))
    return pages.groupBy("doc_id").agg(n.alias("n_pages"), ((side <= limits.max_side_pt) & ((n <= limits.max_pages) | F.lit(limits.max_pages <= 0))).alias("ok"))


def scale(w: Column, h: Column, dpi: Column, most: float = 50e6) -> Column:
    """Pixels for a point, less where the page would have over `most` pixels."""
    plain = dpi / 72.0
    area = w * h * plain * plain
    return F.when(area > most, plain * F.sqrt(F.lit(most) / area)).otherwise(plain)


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file, read by an explicit schema; what can't be read gives nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def responses(raw: DataFrame, engine: str) -> DataFrame:
    """Parsed responses of an engine (column body), identity checked: page rows with the blocks as sent."""
    parsed = raw.withColumn("r", F.from_json("body", schemas.PARSE_RESPONSE)).filter((F.col("r.protocol_version") == 1) & (F.col("r.engine") == engine))
    return parsed.select(*raw.columns, F.explode("r.pages").alias("page"))


def replies(spark: SparkSession, path: str, engine: str, max_mb: int = 20) -> DataFrame:
    """responses() of a folder of an engine's replies, a file each; larger ones are left out."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= max_mb << 20)
    return responses(files.select(F.decode("content", "UTF-8").alias("body")), engine)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Event-stream captures, one record up to each blank line: file, event, data."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.input_file_name().alias("file"), "value")
    return rows.select("file", F.regexp_extract("value", r"(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract("value", r"(?m)^data: ?(.*)$", 1).alias("data")).filter("event <> '' or data <> ''")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    return artifacts(spark, path, schemas.GLOSSARY).withColumn("src", F.lower("src"))


def json_array(reply: Column, schema: str) -> Column:
    """The array within a model's reply, whatever stands around it."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), schema)


def json_object(reply_: Column, schema: str) -> Column:
    """The object within a model's reply, from the first brace to the last; null if there is none."""
    found = F.regexp_extract(reply_, r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.from_json(found, schema))


def error_detail(body: Column, most: int = 300) -> Column:
    """What the body of a failed reply says of its error: its detail or error, where that is text."""
    said = F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in ("detail", "error")])
    return F.coalesce(F.left(F.when(~said.rlike(r"^[\[{]"), said), F.lit(most)), F.lit("(no detail)"))


def preview(body: Column, most: int = 200) -> Column:
    return F.left(body, F.lit(most))


def reply(c: Column) -> Column:
    """A reply without a leading block of thoughts and without a code fence around it."""
    plain = F.trim(F.regexp_replace(c, r"(?s)^\s*<think>.*?</think>", ""))
    return F.regexp_replace(plain, r"(?s)^```[a-z]*\n(.*?)\n?```\s*\z", "$1")


def score(c: Column) -> Column:
    """A score of 1 to 5, ties to even; null if it is none."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.rint(c.try_cast("double")).cast("int")))
