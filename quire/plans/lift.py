"""Inputs of the document operators, derived from the columns of documents by rules that SQL states as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

LABELS = ("title", "text", "table", "formula", "image")
NAMES = ("figure", " Chart ", "equation", "doc_title", "TEXT", "number", "mystery", "header_image", "paragraph", "seal", "table", "vision_footnote")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("k", "line"))


def box(rows: DataFrame) -> DataFrame:
    """lines with page, label and a box that lies inside the page."""
    d, k = F.col("doc_id"), F.col("k")
    x1, y1 = (d * 7 + k * 13) % 900, (d * 3 + k * 29) % 900
    return rows.withColumn("page", (F.floor(k / 6) + 1).cast("int")).withColumn("label", pick(LABELS, k % 5)).withColumn("bbox", F.array(x1, y1, x1 + 20 + (k * 7) % 80, y1 + 10 + (k * 11) % 60))


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, raw: six lines a page, every seventh line under a ref tag with two boxes, the others under a det tag."""
    rows = box(lines(spark, sf_dir))
    text = F.array_join(F.col("bbox").cast("array<string>"), ", ")
    ref = F.concat(F.lit("<|ref|>"), F.col("label"), F.lit("<|/ref|><|det|>[["), text, F.lit("], ["), text, F.lit("]]<|/det|>"), F.col("line"))
    det = F.concat(F.lit("<|det|>"), F.col("label"), F.lit(" ["), text, F.lit("]<|/det|>"), F.col("line"))
    rows = rows.withColumn("tagged", F.when(F.col("k") % 7 == 3, ref).otherwise(det))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tagged"))), lambda x: x["tagged"]), "\n").alias("raw"))


PREVIEW_LABELS = ("title", "page-number", "table", "Title", "image", "Header", "text", "foot-note", "footnote")


def tagged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, raw: six lines a page under tags of all kinds of label, every seventh a ref tag with two boxes; titles over many lines, stray tokens."""
    return tagged(lines(spark, sf_dir))


def tagged(rows: DataFrame) -> DataFrame:
    """tagged_pages of rows (doc_id, k, line)."""
    rows = box(rows).withColumn("label", pick(PREVIEW_LABELS, F.col("k") % 9))
    text = F.array_join(F.col("bbox").cast("array<string>"), ", ")
    line = F.concat(F.when((F.lower("label") == "title") & (F.col("k") % 2 == 1), F.replace("line", F.lit(" "), F.lit("\n"))).otherwise(F.col("line")), F.when(F.col("k") % 11 == 5, "<|/x|>").otherwise(""))
    ref = F.concat(F.lit("<|ref|>"), F.col("label"), F.lit(" <|/ref|><|det|>[["), text, F.lit("], ["), text, F.lit("]]<|/det|>"), line)
    det = F.concat(F.lit("<|det|>"), F.col("label"), F.lit(" ["), text, F.lit("]<|/det|>"), line)
    rows = rows.withColumn("tagged", F.when(F.col("k") % 7 == 3, ref).otherwise(det))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "tagged"))), lambda x: x["tagged"]), "\n").alias("raw"))


#: What stands behind every ninth line: math of both kinds, money, blank math, code of three kinds.
MATHY = (" \\( x + y \\)", " costs $5 and $7 more", "\n~~~\n$ \\( no \\) $\n~~~", " $$ z_k = 1 $$", " $T < 3$ and $n = 2$", " `$c`", " \\[ \\frac{a}{b} \\]", " \\(  \\) $$ $$", '\n```py\na = "$b$"\n```')


def mathy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with math and money."""
    rows = lines(spark, sf_dir).select("doc_id", "k", F.concat("line", pick(MATHY, F.col("k") % len(MATHY))).alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("text"))


def wild_box() -> Column:
    """A box that may lie outside, be reversed or too small."""
    d, k = F.col("doc_id"), F.col("k")
    x1, y1 = (d * 7 + k * 13) % 1060 - 30, (d * 5 + k * 17) % 1060 - 30
    return F.array(x1, y1, x1 + (k * 7) % 90 - 5, y1 + (k * 11) % 70 - 3)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk, num_pages, single, markdown: three pages of six lines a chunk, every third line with an image; one page more or less is expected by rule."""
    rows = lines(spark, sf_dir).withColumn("p", F.floor(F.col("k") / 6).cast("int"))
    line = F.when(F.col("k") % 3 == 2, F.concat("line", F.lit("![](images/page_"), (F.col("p") % 3).cast("string"), F.lit("_"), F.col("k").cast("string"), F.lit(".jpg)"))).otherwise(F.col("line"))
    pages = rows.groupBy("doc_id", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("x")))), lambda r: r["x"]), "\n").alias("md"))
    pages = pages.withColumn("chunk", F.floor(F.col("p") / 3).cast("int"))
    out = pages.groupBy("doc_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.concat(F.lit("<PAGE>"), "md").alias("x")))), lambda r: r["x"]), "").alias("markdown"), F.count("*").cast("int").alias("n"))
    expected = F.greatest(F.lit(1), F.col("n") + ((F.col("doc_id") + F.col("chunk")) % 3).cast("int") - 1)
    return out.select("doc_id", "chunk", expected.cast("int").alias("num_pages"), F.lit(False).alias("single"), "markdown")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word as a text span on a page of 612 x 792 points."""
    rows = lines(spark, sf_dir).select("doc_id", "k", F.posexplode(F.split("line", " ", -1)).alias("j", "text"))
    d, k, j = F.col("doc_id"), F.col("k"), F.col("j")
    x0, y0 = ((j * 37 + d) % 560).cast("double"), ((k * 23 + j * 5) % 780).cast("double")
    return rows.select(
        "doc_id", (F.floor(k / 6) + 1).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 20).alias("x1"), (y0 + 10).alias("y1"), (j % 5 + 8).cast("double").alias("size"), "text",
        F.when(j % 3 == 0, 16).otherwise(0).alias("flags"), F.when(j % 7 == 0, "Sans-Bold").otherwise("Sans").alias("font"), F.when(k % 4 == 0, -1.0).otherwise(0.0).alias("dir_y"),
    )


def tokened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, line with a formula, a citation, a reference, an address or code put in by rule, and words that are nearly entries of the glossary."""
    k = F.col("k")
    s = k.cast("string")
    more = F.when(k % 5 == 0, F.concat(F.lit(" $x_"), s, F.lit("$"))).when(k % 5 == 1, F.concat(F.lit(" ["), s, F.lit("]"))).when(k % 5 == 2, F.concat(F.lit(" see Figure "), s)).when(k % 5 == 3, F.concat(F.lit(" https://example.org/"), s)).otherwise(F.concat(F.lit(" `c"), s, F.lit("`")))
    near = F.when(k % 6 == 0, " fine. Tuning of C code").when(k % 6 == 1, " $de la$ fine-tuning").when(k % 6 == 2, " of  the C++x").otherwise("")
    return lines(spark, sf_dir).select("doc_id", "k", F.concat("line", more, near).alias("line"))


def troubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, line of tokened(), with words in lines that tell a careless translator how to fail, and no double dollars."""
    k, line = F.col("k"), F.replace("line", F.lit("$$"), F.lit(""))
    way = F.when(k % 4 == 0, " qqalways").when(k % 4 == 1, " qqmend").otherwise("")
    seen = F.when(k % 5 == 2, F.replace(line, F.lit(" see Figure"), F.concat(way, F.lit(" see Figure")))).otherwise(line)
    head = F.concat(F.when((k % 5 == 2) & (k % 4 == 2), "qqsplit ").otherwise(""), F.when(k % 7 == 5, "qqcached ").otherwise(""), F.when(k % 5 == 1, "qqinvent ").otherwise(""))
    return tokened(spark, sf_dir).select("doc_id", "k", F.concat(F.lit("P "), head, seen).alias("line"))


GLOSSARY = (("the", "das", "B"), ("of the", "von dem", "C"), ("la", "el", "B"), ("de la", "del", "D"), ("und", "and", "C"), ("is and", "ist und", "D"), ("IN", "IN", "A"), ("fine-tuning", "Feinabstimmung", "D"), ("C++", "C++", "A"))


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GLOSSARY), "src string, ko string, policy string")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs."""
    kind = F.pmod(F.col("event_id"), F.lit(4))
    status = F.when(kind == 0, "queued").when(kind == 1, "running").when(kind == 2, "done").otherwise("error")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), status.alias("status"), ts.alias("created_at"), ts.alias("updated_at"), F.when(kind == 2, ts + F.expr("interval 1 hour")).alias("translated_at"))
