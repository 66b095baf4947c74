"""Grounding-tagged page text to typed blocks, and what is drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import render

# The two forms of a tag.
REF = r"<\|ref\|>(.{1,40}?)<\|/ref\|><\|det\|>(.{0,400}?)<\|/det\|>"
DET = r"<\|det\|>\s*([A-Za-z_][\w-]*)\s*\[([^\]]+)\]\s*<\|/det\|>"
TAG = f"(?s)(?:{REF}|{DET})"


def parse_blocks(raw_pages: DataFrame) -> DataFrame:
    """(doc_id, page, raw) to one row for each box of each tag: block_no, type, bbox, content, crop_index.

    A tag's text runs to the next tag. Tags are matched by one alternation with the ref form first, so a det inside a
    ref is part of it. Crops count the images of ref tags before those of det tags; images have no content.
    """
    found = raw_pages.select("doc_id", "page", F.regexp_extract_all("raw", F.lit(TAG), 0).alias("tags"), F.split("raw", TAG, -1).alias("pieces"))
    tags = found.select("doc_id", "page", F.posexplode(F.arrays_zip("tags", F.slice("pieces", F.lit(2), F.size("tags")).alias("after"))).alias("tag_no", "t"))
    is_ref = F.col("t.tags").startswith("<|ref|>")
    label = F.when(is_ref, F.regexp_extract("t.tags", f"(?s)^{REF}", 1)).otherwise(F.regexp_extract("t.tags", f"(?s)^{DET}", 1))
    payload = F.when(is_ref, F.regexp_extract("t.tags", f"(?s)^{REF}", 2)).otherwise(F.regexp_extract("t.tags", f"(?s)^{DET}", 2))
    rows = tags.select("doc_id", "page", "tag_no", is_ref.alias("is_ref"), T.strip(label).alias("label"), T.strip(F.regexp_replace("t.after", T.SPECIAL, "")).alias("after"), F.posexplode(T.quads(payload)).alias("box_no", "bbox"))
    image = F.col("label") == "image"
    crops = Window.partitionBy("doc_id", "page", image).orderBy(F.desc("is_ref"), "tag_no", "box_no")
    order = Window.partitionBy("doc_id", "page").orderBy("tag_no", "box_no")
    return rows.select(
        "doc_id", "page", (F.row_number().over(order) - 1).alias("block_no"), F.lower("label").alias("type"), "bbox",
        F.when(image, "").otherwise(F.col("after")).alias("content"), F.when(image, F.row_number().over(crops) - 1).alias("crop_index"),
    )


def raw_fragment(type_: Column, bbox: Column, content: Column) -> Column:
    """A block as tagged text, the inverse of parse_blocks."""
    return F.concat(F.lit("<|det|>"), type_, F.lit(" ["), F.array_join(bbox.cast("array<string>"), ", "), F.lit("]<|/det|>"), content)


def percent(v: Column) -> Column:
    """A coordinate of 0-999 as a percentage with two decimals, ties to even."""
    return F.format_number(v / F.lit(999.0) * 100, 2)


def font_size(bbox: Column, content: Column, aspect: Column) -> Column:
    """Estimated font size in hundredths of the page's width, from the box's area and its characters' widths; null if there is nothing to tell."""

    def weighed(plain: Column) -> Column:
        n, ascii_ = F.length(plain), F.length(F.regexp_replace(plain, r"[^\x00-\x7f]+", ""))
        # Blocks of full-width scripts.
        wide = F.length(F.regexp_replace(plain, "[^ᄀ-ᇿ⺀-鿿ꥠ-꥿가-퟿豈-﫿＀-￯]+", ""))
        mixed = T.let(F.struct(n.alias("n"), ascii_.alias("a"), wide.alias("w")), lambda x: x["a"] * 0.5 + x["w"] * 1.0 + (x["n"] - x["a"] - x["w"]) * 0.65)
        return F.when(F.octet_length(plain) == n, n * 0.5).otherwise(mixed)

    def of_weight(weight: Column) -> Column:
        size = F.least(F.sqrt(w * h / (weight * 1.2)), h / 1.25)
        return F.when((F.size(bbox) == 4) & (weight >= 1) & (w > 0) & (h > 0), F.greatest(F.lit(0.8), F.least(F.lit(3.6), size)))

    w = (bbox[2] - bbox[0]) / F.lit(999.0) * 100
    h = (bbox[3] - bbox[1]) / F.lit(999.0) * 100 * aspect
    # the text is read once, however often its weight is named
    return T.let(T.let(T.squeeze(F.regexp_replace(content, "<[^>]+>", " ")), weighed), of_weight)


def drawn_size(fs: Column, estimate: Column) -> Column:
    """Measured size within its bounds, else the estimate."""
    return F.coalesce(F.greatest(F.lit(0.6), F.least(F.lit(6.0), fs)), estimate)


def vertical(fs: Column, given: Column, bbox: Column, content: Column, aspect: Column) -> Column:
    """Given direction, else 'up' for unmeasured boxes of at least 12 characters that are six times as high as wide on the page."""
    w, h = bbox[2] - bbox[0], (bbox[3] - bbox[1]) * aspect
    tall = (w > 0) & (h >= w * 6) & (F.length(F.coalesce(content, F.lit(""))) >= 12)
    return F.coalesce(F.when(given.isin("up", "down"), given), F.when(fs.isNull() & tall, "up"))


def safe_type(c: Column) -> Column:
    return F.when(c.rlike(r"^[a-z][a-z0-9_-]{0,24}\z"), c).otherwise("text")


def layout_html(blocks: DataFrame, pages: DataFrame, base_url: str, lang: str | None = None) -> DataFrame:
    """doc_id, html of blocks (doc_id, page, block_no, type, bbox, content) on pages (doc_id, page, width, height): positioned boxes in order, a section for each page.

    Optional columns of blocks: image (a file name), fs, bold, vertical. Sides are clamped to the page and not under 4;
    a page without a size has that of a sheet.
    """
    absent = {"image": "string", "fs": "double", "bold": "boolean", "vertical": "string"}
    rows = blocks.select("*", *[F.lit(None).cast(t).alias(c) for c, t in absent.items() if c not in blocks.columns]).filter(F.size("bbox") == 4)
    sheet = pages.select("doc_id", "page", F.when(F.col("width") > 0, F.col("width")).otherwise(1000).alias("w"), F.when(F.col("height") > 0, F.col("height")).otherwise(1414).alias("h"))
    sheet = sheet.withColumn("aspect", F.col("h") / F.col("w"))
    box = F.transform("bbox", lambda v: F.greatest(F.lit(0), F.least(F.lit(999), v.cast("int"))))
    rows = rows.withColumn("bbox", box).join(sheet, ["doc_id", "page"])
    x1, y1, x2, y2 = (F.col("bbox")[i] for i in range(4))
    side = lambda v: percent(F.greatest(v, F.lit(4)))
    style = F.concat(F.lit("left:"), percent(x1), F.lit("%;top:"), percent(y1), F.lit("%;width:"), side(x2 - x1), F.lit("%;height:"), side(y2 - y1), F.lit("%;"))
    kind = safe_type(F.coalesce("type", F.lit("text")))
    image = F.concat(F.lit(f'<img class="layout-block layout-image" src="{base_url}/images/'), F.col("image"), F.lit('" style="'), style, F.lit('" alt="">'))
    body = render.with_math(F.coalesce("content", F.lit("")))
    body = F.when(kind == "table", render.table_tags(body)).otherwise(body)
    size = drawn_size(F.col("fs"), font_size(F.col("bbox"), body, F.col("aspect")))
    bold = F.when(F.col("bold") & (kind != "title"), "font-weight:600;").otherwise("")
    font = F.when(size.isNotNull(), F.concat(F.lit("font-size:"), F.format_string("%.2f", size), F.lit("cqw;line-height:1.22;"), bold)).otherwise("")
    turned = F.coalesce(F.concat(F.lit(" layout-vertical-"), vertical(F.col("fs"), F.col("vertical"), F.col("bbox"), F.col("content"), F.col("aspect"))), F.lit(""))
    text = F.concat(F.lit('<div class="layout-block layout-'), kind, turned, F.lit('" style="'), style, font, F.lit('" title="'), kind, F.lit('">'), body, F.lit("</div>"))
    named = F.coalesce(F.col("image").rlike(rf"^[{T.LETTERS}.-]+\z"), F.lit(False))
    drawn = rows.select("doc_id", "page", "block_no", F.when(named, image).otherwise(text).alias("html"))
    ordered = lambda key: F.transform(F.array_sort(F.collect_list(F.struct(key, "html"))), lambda x: x["html"])
    whole = drawn.groupBy("doc_id", "page").agg(F.array_join(ordered("block_no"), "").alias("html"))
    whole = sheet.join(whole, ["doc_id", "page"], "left")  # a page without blocks is a page
    head = F.concat(F.lit('<section class="layout-page" data-page="'), F.col("page").cast("string"), F.lit('"><div class="layout-canvas" style="padding-top:'), F.format_string("%.2f", F.col("aspect") * 100), F.lit('%">'))
    whole = whole.select("doc_id", "page", F.concat(head, F.coalesce("html", F.lit("")), F.lit("</div></section>")).alias("html"))
    out = whole.groupBy("doc_id").agg(F.array_join(ordered("page"), "\n").alias("html"))
    return out if lang is None else out.withColumn("html", F.concat(F.lit(f'<div class="doclayout-body" lang="{lang}">\n'), F.col("html"), F.lit("\n</div>")))
