"""Pages out of chunks of Markdown, their images, fallbacks and the whole document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

SEPARATOR = "\n\n---\n\n"


def split_pages(md: Column) -> Column:
    """Parts between page markers, trimmed; blank text before the first marker is no page."""
    parts = F.split(md, "<PAGE>", -1)
    own = F.when((F.size(parts) > 0) & (T.strip(parts[0]) == ""), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    return F.transform(own, T.strip)


def repaired(pages: Column, expected: Column) -> Column:
    """Exactly `expected` pages: a surplus joins the last one, missing ones are empty."""
    surplus = F.concat(F.slice(pages, F.lit(1), expected - 1), F.array(F.array_join(F.slice(pages, expected, F.size(pages)), "\n\n")))
    return F.when(F.size(pages) > expected, surplus).otherwise(F.concat(pages, F.array_repeat(F.lit(""), expected - F.size(pages))))


def global_name(page: Column, k: Column) -> Column:
    return F.concat(F.format_string("p%04d_", page.cast("int")), k, F.lit(".jpg"))


def rewritten(md: Column, start_page: Column, single: Column) -> Column:
    """Image references by their document-wide names."""
    multi, one = r"!\[\]\(images/page_(\d+)_(\d+)\.jpg\)", r"!\[\]\(images/(\d+)\.jpg\)"

    def renamed(pattern: str, name) -> Column:
        pieces, tags = F.split(md, pattern, -1), F.regexp_extract_all(md, F.lit(pattern), 0)
        links = F.transform(tags, lambda t: F.concat(F.lit("![](images/"), name(t), F.lit(")")))
        return F.array_join(F.zip_with(pieces, links, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")

    in_chunk = renamed(multi, lambda t: global_name(start_page + F.regexp_extract(t, multi, 1).cast("int"), F.regexp_extract(t, multi, 2)))
    return F.when(single, renamed(one, lambda t: global_name(start_page, F.regexp_extract(t, one, 1)))).otherwise(in_chunk)


def renamed_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files (doc_id, chunk, name, meta) of chunks (doc_id, chunk, start_page, single) by their document-wide names: (doc_id, folder, name, meta).

    Figures keep the meta of their boxes; drawings of whole pages go to layout; files of other names are left behind.
    """
    rows = files.join(chunks.select("doc_id", "chunk", "start_page", "single"), ["doc_id", "chunk"])
    name, one, multi, drawn = F.col("name"), r"^images/(\d+)\.jpg\z", r"^images/page_(\d+)_(\d+)\.jpg\z", r"^result_with_boxes_(\d+)\.jpg\z"
    page = lambda p: F.col("start_page") + F.regexp_extract(name, p, 1).cast("int")
    sheet = lambda n: F.concat(F.format_string("page_%04d", n.cast("int")), F.lit(".jpg"))
    single = F.when(name.rlike(one), global_name(F.col("start_page"), F.regexp_extract(name, one, 1))).when(name == "result_with_boxes.jpg", sheet(F.col("start_page")))
    many = F.when(name.rlike(multi), global_name(page(multi), F.regexp_extract(name, multi, 2))).when(name.rlike(drawn), sheet(page(drawn)))
    rows = rows.withColumn("new", F.when(F.col("single"), single).otherwise(many)).filter("new is not null")
    figure = F.col("new").startswith("p") & ~F.col("new").startswith("page_")
    return rows.select("doc_id", F.when(figure, "images").otherwise("layout").alias("folder"), F.col("new").alias("name"), F.when(figure, F.col("meta")).alias("meta"))


def live_text(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text) of pages (doc_id, page, md) as they are streamed: a figure's placeholder as the tag of its block's box, none where it has no box."""
    boxes = blocks.filter("type = 'image' and figure_index is not null and bbox is not null").groupBy("doc_id", "page").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("figure_index").cast("string"), "bbox")))).alias("boxes"))
    rows = pages.join(boxes, ["doc_id", "page"], "left")
    place = r"\[\[FIGURE:(\d+)\]\]"
    tag = lambda n: F.coalesce(F.concat(F.lit("<|det|>image ["), F.array_join(F.try_element_at("boxes", n).cast("array<string>"), ", "), F.lit("]<|/det|>")), F.lit(""))
    tags = F.concat(F.transform(F.regexp_extract_all("md", F.lit(place), F.lit(1)), tag), F.array(F.lit("")))
    return rows.select("doc_id", "page", F.array_join(F.zip_with(F.split("md", place, -1), tags, lambda a, b: F.concat(a, b)), "").alias("text"))


def chunk_pages(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk, num_pages, single, markdown) to (doc_id, page, md, n_markers): page numbers run on over the document, or from a chunk's first_page where it has one."""
    ahead = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("first_page") if "first_page" in chunks.columns else F.coalesce(F.sum("num_pages").over(ahead), F.lit(0)) + 1
    rows = chunks.withColumn("start_page", first.cast("int"))
    pages = F.when(F.col("single"), F.array("markdown")).otherwise(split_pages(F.col("markdown")))
    rows = rows.withColumn("found", pages).withColumn("n_markers", F.size("found"))
    rows = rows.select("doc_id", "start_page", "single", "n_markers", F.posexplode(repaired(F.col("found"), F.col("num_pages"))).alias("local", "md"))
    clean = T.strip(F.regexp_replace(rewritten(F.col("md"), F.col("start_page"), F.col("single")), T.SPECIAL, ""))
    return rows.select("doc_id", (F.col("start_page") + F.col("local")).alias("page"), clean.alias("md"), "n_markers")


def chunk_warnings(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk, start_page, found, expected, kind) of chunks whose pages had to be repaired: 'surplus' or 'missing'."""
    ahead = Window.partitionBy("doc_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(F.col("single"), F.lit(1)).otherwise(F.size(split_pages(F.col("markdown"))))
    rows = chunks.select("doc_id", "chunk", (F.coalesce(F.sum("num_pages").over(ahead), F.lit(0)) + 1).cast("int").alias("start_page"), found.alias("found"), F.col("num_pages").alias("expected"))
    return rows.filter("found <> expected").withColumn("kind", F.when(F.col("found") > F.col("expected"), "surplus").otherwise("missing"))


def documents(pages: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """doc_id, markdown: pages in order, trimmed, with a newline at the end."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "md"))), lambda x: x["md"])
    return pages.groupBy("doc_id").agg(F.concat(T.strip(F.array_join(ordered, separator)), F.lit("\n")).alias("markdown"))


def chunk_of(page: Column, size: int) -> Column:
    return F.floor((page - 1) / size).cast("int")


def page_span(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


PLACEHOLDER = r"\[\[FIGURE:(\d{1,3})\]\]"


def place_figures(pages: DataFrame, crops: DataFrame) -> DataFrame:
    """(doc_id, page, md) with placeholders, (doc_id, page, figure_index, name): references instead; unknown ones go, crops without a placeholder follow at the end, those without an index last."""
    pieces = pages.select("doc_id", "page", F.split("md", PLACEHOLDER, -1).alias("p"), F.regexp_extract_all("md", F.lit(PLACEHOLDER), 1).alias("k"))
    rows = pieces.select("doc_id", "page", F.posexplode(F.arrays_zip("p", F.concat(F.array(F.lit(None).cast("string")), "k").alias("k"))).alias("pos", "t")).select("doc_id", "page", "pos", F.col("t.p").alias("piece"), F.col("t.k").cast("int").alias("figure_index"))
    named = crops.filter("figure_index is not null").groupBy("doc_id", "page", "figure_index").agg(F.max("name").alias("name"))
    met = rows.join(named, ["doc_id", "page", "figure_index"], "left")
    link = lambda c: F.concat(F.lit("![](images/"), c, F.lit(")"))
    body = met.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.coalesce(link(F.col("name")), F.lit("")), "piece").alias("x")))), lambda x: x["x"]), "").alias("md"))
    left = named.join(rows.select("doc_id", "page", "figure_index"), ["doc_id", "page", "figure_index"], "left_anti").unionByName(crops.filter("figure_index is null").select("doc_id", "page", "figure_index", "name"))
    tail = left.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("figure_index", F.lit(2**31 - 1)).alias("o"), "name"))), lambda x: F.concat(F.lit("\n\n"), link(x["name"]))), "").alias("tail"))
    return body.join(tail, ["doc_id", "page"], "left").select("doc_id", "page", T.strip(F.concat(F.regexp_replace("md", T.WHITE + r"+\z", ""), F.coalesce("tail", F.lit("")))).alias("md"))


def fallback(expected: DataFrame, multi: DataFrame, single: DataFrame, text_layer: DataFrame, placeholder: str = "*[page failed]*") -> DataFrame:
    """For every expected (doc_id, page): the chunk's page, else the page by itself, else its text layer, else a placeholder, and which it is."""
    out = expected
    for name, df in (("multi", multi), ("single", single), ("text_layer", text_layer)):
        out = out.join(df.select("doc_id", "page", F.col("md").alias(name)), ["doc_id", "page"], "left")
    source = F.when(F.col("multi").isNotNull(), "multi").when(F.col("single").isNotNull(), "single").when(F.col("text_layer").isNotNull(), "text_layer").otherwise("placeholder")
    return out.select("doc_id", "page", F.coalesce("multi", "single", "text_layer", F.lit(placeholder)).alias("md"), source.alias("source"))
