"""Sanitation of what models and providers return: boxes, types, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import repetition

# The known block types, other names for them, and a provider's labels.
TYPES = ("title", "text", "table", "formula", "image", "header", "footer", "footnote", "page_number", "unknown")
ALIASES = {
    "figure": "image", "picture": "image", "chart": "image", "seal": "image", "equation": "formula", "doc_title": "title", "paragraph_title": "title",
    "vision_footnote": "footnote", "number": "page_number", "aside_text": "text", "content": "text", "paragraph": "text", "header_image": "header", "footer_image": "footer",
}
LABELS = {
    "doc_title": "title", "paragraph_title": "title", "text": "text", "abstract": "text", "content": "text", "aside_text": "text", "figure_title": "text", "table_title": "text",
    "chart_title": "text", "reference": "text", "reference_content": "text", "formula_number": "text", "algorithm": "text", "table": "table", "formula": "formula",
    "display_formula": "formula", "inline_formula": "formula", "equation": "formula", "image": "image", "chart": "image", "seal": "image", "figure": "image", "header": "header",
    "header_image": "header", "footer": "footer", "footer_image": "footer", "footnote": "footnote", "vision_footnote": "footnote", "number": "page_number",
}
NOT_IN_MARKDOWN = ("number", "footnote", "header", "header_image", "footer", "footer_image", "aside_text")
MOST, MARGIN, LEAST_SIDE, BLOCKS, FIGURES, CONTENT, MARKDOWN = 999, 25, 2, 512, 64, 100_000, 400_000


def mapped(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def block_type(c: Column) -> Column:
    name = F.lower(T.strip(c))
    return F.when(name.isin(*TYPES), name).otherwise(F.coalesce(mapped(name, ALIASES), F.lit("unknown")))


def valid_box(values: Column) -> Column:
    """Whether an array of doubles is four whole numbers below ten million."""
    return F.coalesce((F.size(values) == 4) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e7) & (v == F.floor(v))), F.lit(False))


def clamp_box(b: Column) -> Column:
    """Small overruns clamped to 0-999; null if any is large or a side is too short."""
    near = F.forall(b, lambda v: (v >= -MARGIN) & (v <= MOST + MARGIN))
    inside = F.transform(b, lambda v: F.greatest(F.lit(0), F.least(F.lit(MOST), v)))
    return F.when(near & (inside[2] - inside[0] >= LEAST_SIDE) & (inside[3] - inside[1] >= LEAST_SIDE), inside)


def pixel_box(b: Column, width: Column, height: Column) -> Column:
    """A pixel box on the 0-999 grid, ties to even; null if it is degenerate or lies outside by over 2 % and 2 pixels."""
    mx, my = width * 0.02 + 2, height * 0.02 + 2
    ok = (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e7)) & (b[2] > b[0]) & (b[3] > b[1])
    ok &= (b[0] >= -mx) & (b[1] >= -my) & (b[2] <= width + mx) & (b[3] <= height + my)
    one = lambda v, n: F.when(n > 0, F.greatest(F.lit(0), F.least(F.lit(MOST), F.rint(v / n * MOST).cast("int")))).otherwise(0)
    out = F.array(one(b[0], width), one(b[1], height), one(b[2], width), one(b[3], height))
    return F.when(ok & (out[2] - out[0] >= LEAST_SIDE) & (out[3] - out[1] >= LEAST_SIDE), out)


def sanitize_pages(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, pos, type, bbox, content, order, figure_index) as they may go on: capped by position, in stable order, images only with a box and up to a number, figure indexes unique."""
    page = Window.partitionBy("doc_id", "page")
    rows = blocks.withColumn("nth", F.row_number().over(page.orderBy("pos"))).filter(F.col("nth") <= BLOCKS)
    rows = rows.withColumn("type", block_type(F.col("type"))).withColumn("bbox", clamp_box(F.col("bbox")))
    rows = rows.filter((F.col("type") != "image") | F.col("bbox").isNotNull())
    image = F.col("type") == "image"
    rows = rows.withColumn("figure_no", F.when(image, F.sum(image.cast("int")).over(page.orderBy("order", "pos"))))
    rows = rows.filter(~image | (F.col("figure_no") <= FIGURES))
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "type", "figure_index").orderBy("order", "pos"))
    rows = rows.withColumn("figure_index", F.when(image & (F.col("figure_index") >= 0) & (first == 1), F.col("figure_index")))
    rows = rows.withColumn("content", F.left(T.strip_special(F.col("content")), F.lit(CONTENT)))
    return rows.withColumn("block_no", F.row_number().over(page.orderBy("order", "pos")) - 1).select("doc_id", "page", "block_no", "type", "bbox", "content", "figure_index")


def sanitize_warnings(blocks: DataFrame) -> DataFrame:
    """What sanitize_pages drops or changes: (doc_id, page, order, pos, kind, detail).

    kind 'blocks' for a page of too many (detail: how many, without a place), and of single blocks 'box' for one out of
    range, 'no box' for an image without any, 'content' for a text that is cut, 'figures' for an image over the number,
    'index' for a figure index that is negative or taken (detail: the index).
    """
    page = Window.partitionBy("doc_id", "page")
    rows = blocks.withColumn("nth", F.row_number().over(page.orderBy("pos"))).withColumn("n", F.count("*").over(page))
    many = rows.filter((F.col("nth") == 1) & (F.col("n") > BLOCKS)).select("doc_id", "page", F.lit(None).cast("int").alias("order"), F.lit(None).cast("int").alias("pos"), F.lit("blocks").alias("kind"), F.col("n").cast("string").alias("detail"))
    rows = rows.filter(F.col("nth") <= BLOCKS).withColumn("kept", clamp_box(F.col("bbox"))).withColumn("image", block_type(F.col("type")) == "image")
    drawn = F.col("image") & F.col("kept").isNotNull()
    rows = rows.withColumn("figure_no", F.when(drawn, F.sum(drawn.cast("int")).over(page.orderBy("order", "pos"))))
    drawn &= F.col("figure_no") <= FIGURES
    rows = rows.withColumn("drawn", F.coalesce(drawn, F.lit(False)))
    rows = rows.withColumn("taken", F.row_number().over(Window.partitionBy("doc_id", "page", "drawn", "figure_index").orderBy("order", "pos")) > 1)
    said = lambda kind, when, detail: F.when(when, F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail")))
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(
        said("box", F.col("bbox").isNotNull() & F.col("kept").isNull(), none),
        said("content", (~F.col("image") | F.col("kept").isNotNull() | F.col("bbox").isNull()) & (F.length(T.strip_special(F.col("content"))) > CONTENT), none),
        said("no box", F.col("image") & F.col("bbox").isNull(), none),
        said("figures", F.col("figure_no") > FIGURES, none),
        said("index", F.col("drawn") & F.col("figure_index").isNotNull() & ((F.col("figure_index") < 0) | F.col("taken")), F.col("figure_index")),
    ))
    single = rows.select("doc_id", "page", F.col("order").cast("int").alias("order"), F.col("pos").cast("int").alias("pos"), F.explode(found).alias("w"))
    return many.unionByName(single.select("doc_id", "page", "order", "pos", "w.kind", "w.detail"))


def clean_markdown(text: Column) -> tuple[Column, Column]:
    """(a page's Markdown without control tokens, up to MARKDOWN characters; what was changed: 'control', 'length')."""
    clean = T.strip_special(text)
    found = F.array(F.when(text.rlike(f"{T.SPECIAL}|<PAGE>"), "control"), F.when(F.length(clean) > MARKDOWN, "length"))
    return F.left(clean, F.lit(MARKDOWN)), F.array_compact(found)


def fragment(label: Column, type_: Column, content: Column, figure: Column) -> Column:
    """A block's Markdown: null for page furniture and empty blocks, figures by reference, titles as headings, bare formulas as display math."""
    body = T.strip(content)
    return (
        F.when(label.isin(*NOT_IN_MARKDOWN), None)
        .when(figure.isNotNull(), F.concat(F.lit("[[FIGURE:"), figure.cast("string"), F.lit("]]")))
        .when(body == "", None)
        .when(label == "doc_title", F.concat(F.lit("# "), body))
        .when(label == "paragraph_title", F.concat(F.lit("## "), body))
        .when((type_ == "formula") & ~body.rlike(r"\$|\\\[|\\\("), F.concat(F.lit("\\[ "), body, F.lit(" \\]")))
        .otherwise(body)
    )


def provider_pages(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider blocks (doc_id, page, pos, label, bbox in pixels, content, block_order, width, height) to (blocks, Markdown of pages)."""
    page = Window.partitionBy("doc_id", "page")
    rows = blocks.filter(F.col("pos") < BLOCKS).withColumn("label", F.lower(T.strip(F.coalesce("label", F.lit("")))))
    rows = rows.withColumn("order", F.row_number().over(page.orderBy(F.coalesce("block_order", "pos"), "pos")) - 1)
    rows = rows.withColumn("type", F.coalesce(mapped(F.col("label"), LABELS), F.lit("unknown"))).withColumn("bbox", pixel_box(F.col("bbox"), F.col("width"), F.col("height")))
    rows = rows.filter((F.col("type") != "image") | F.col("bbox").isNotNull())
    image = F.col("type") == "image"
    rows = rows.withColumn("figure_index", F.when(image, F.sum(image.cast("int")).over(page.orderBy("order")) - 1)).filter(~image | (F.col("figure_index") < FIGURES))
    rows = rows.withColumn("content", F.left(F.regexp_replace(F.coalesce("content", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), F.lit(CONTENT)))
    rows = rows.withColumn("md", fragment(F.col("label"), F.col("type"), F.col("content"), F.col("figure_index")))
    parts = F.array_sort(F.collect_list(F.when(F.col("md").isNotNull(), F.struct("order", "md"))))
    pages = rows.groupBy("doc_id", "page").agg(T.strip(F.array_join(F.transform(parts, lambda x: x["md"]), "\n\n")).alias("markdown"))
    return rows.select("doc_id", "page", "order", "type", "bbox", F.when(image, "").otherwise(F.col("content")).alias("content"), "figure_index"), pages


def figure_box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box of 0..1000 on the 0-999 grid; null if out of range or too small."""
    values = [F.least(v, F.lit(MOST)) for v in (left, top, right, bottom)]
    ok = (F.least(left, top, right, bottom) >= 0) & (F.greatest(left, top, right, bottom) <= MOST + 1)
    return F.when(ok & (values[2] - values[0] >= LEAST_SIDE) & (values[3] - values[1] >= LEAST_SIDE), F.array(*values))


# Figure tags in a model's output; all other img tags, and such as never end.
FIGURE_TAG = r"<img\s+src=\"images/bbox_(\d{1,4})_(\d{1,4})_(\d{1,4})_(\d{1,4})\.jpg\"\s*/?>"
ANY_TAG, OPEN_TAG = r"(?i)<img\b[^>]{0,500}?/?>", r"(?i)<img\b[^>\n]{0,500}"


def figure_tags(raw: DataFrame) -> DataFrame:
    """(doc_id, raw) with figure tags to (doc_id, markdown, figures, warnings): valid first boxes become placeholders, every other img tag goes, a repeated suffix is cut.

    The whole output is looked at. warnings, in order: for each tag that goes 'box' (out of range or too small), 'twice'
    or 'figures' (beyond FIGURES), then 'tags <n>', 'open <n>' and 'suffix'.
    """
    found = raw.select("doc_id", F.regexp_extract_all("raw", F.lit(FIGURE_TAG), 0).alias("tags"), F.split("raw", FIGURE_TAG, -1).alias("pieces"))
    rows = found.select("doc_id", F.posexplode(F.arrays_zip("pieces", F.concat(F.array(F.lit(None).cast("string")), "tags").alias("tags"))).alias("pos", "t"))
    numbers = T.numbers(F.regexp_extract("t.tags", r"bbox_([\d_]+)", 1))
    is_tag = F.col("t.tags").isNotNull()
    rows = rows.select("doc_id", "pos", F.col("t.pieces").alias("piece"), is_tag.alias("is_tag"), F.when(is_tag, figure_box(*[numbers[i] for i in range(4)])).alias("bbox"))
    first = F.row_number().over(Window.partitionBy("doc_id", "bbox").orderBy("pos")) == 1
    rows = rows.withColumn("first", first).withColumn("good", F.col("bbox").isNotNull() & F.col("first"))
    rows = rows.withColumn("n", F.sum(F.col("good").cast("int")).over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    good = F.col("good") & (F.col("n") < FIGURES)
    text = F.concat(F.when(good, F.concat(F.lit("[[FIGURE:"), F.col("n").cast("string"), F.lit("]]"))).otherwise(""), F.col("piece"))
    # a box that comes again behind the last figure that fits was never one
    why = F.when(~F.col("is_tag") | good, None).when(F.col("bbox").isNull(), "box").when(~F.col("first") & (_first_place() < FIGURES), "twice").otherwise("figures")
    rows = rows.withColumn("why", why)
    out = rows.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("x")))), lambda x: x["x"]), "").alias("md"),
        F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("n", "bbox")))), lambda x: x["bbox"]).alias("figures"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("pos", "why")))), lambda x: x["why"]).alias("gone"),
    )
    out = out.withColumn("bare", F.regexp_replace("md", ANY_TAG, "")).withColumn("clean", F.regexp_replace("bare", OPEN_TAG, "")).withColumn("whole", repetition.clean_suffix("clean"))
    count = lambda name, text, pattern: F.when(F.regexp_count(text, F.lit(pattern)) > 0, F.concat(F.lit(name + " "), F.regexp_count(text, F.lit(pattern)).cast("string")))
    told = F.concat("gone", F.array(count("tags", "md", ANY_TAG), count("open", "bare", OPEN_TAG), F.when(F.length("whole") != F.length("clean"), "suffix")))
    return out.select("doc_id", T.strip(F.col("whole")).alias("markdown"), "figures", F.array_compact(told).alias("warnings"))


def _first_place() -> Column:
    """The place among the figures of a box's first tag."""
    return F.min(F.when(F.col("good"), F.col("n"))).over(Window.partitionBy("doc_id", "bbox"))
