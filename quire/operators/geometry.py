"""Rectangles, fonts measured from text spans, overlap of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_pixels(v: Column, size: Column) -> Column:
    """A coordinate of 0-999 in pixels, truncated."""
    return (v / F.lit(999.0) * size).cast("int")


def crop_rect(b: Column, width: Column, height: Column, least: int = 4) -> Column:
    """Pixel rectangle of a box inside the page; null if a side is under `least`."""
    x1, x2 = (F.greatest(F.lit(0), F.least(width, to_pixels(b[i], width))) for i in (0, 2))
    y1, y2 = (F.greatest(F.lit(0), F.least(height, to_pixels(b[i], height))) for i in (1, 3))
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), F.array(x1, y1, x2, y2))


def crop_rects(boxes: Column, width: Column, height: Column) -> Column:
    """Pixel rectangles of a list of boxes, one for each, cut at the page; null for one without an area."""

    def one(b: Column) -> Column:
        x1, y1 = F.greatest(F.lit(0), to_pixels(b[0], width)), F.greatest(F.lit(0), to_pixels(b[1], height))
        x2, y2 = F.least(width, to_pixels(b[2], width)), F.least(height, to_pixels(b[3], height))
        return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))

    return F.transform(boxes, one)


def to_grid(v: Column, size: Column) -> Column:
    """A pixel coordinate on the grid of 0-999, ties to even."""
    return F.rint(v / F.greatest(size, F.lit(1)) * 999).cast("int")


def figure_width(x1: Column, x2: Column, page_width: Column) -> tuple[Column, Column]:
    """(share of the page's width, whether to centre): null outside (0, 1.5], at least 0.08 and at most 1."""
    share = (x2 - x1) / page_width
    share = F.when((share > 0) & (share <= 1.5), F.greatest(F.lit(0.08), F.least(F.lit(1.0), share)))
    return share, share < 0.6


def iou(p: Column, q: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(p[2], q[2]) - F.greatest(p[0], q[0]))
    h = F.greatest(F.lit(0), F.least(p[3], q[3]) - F.greatest(p[1], q[1]))
    both = w * h
    area = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - both
    return F.when(area > 0, both / area).otherwise(0.0)


def greedy_iou(found: Column, truth: Column) -> Column:
    """Mean over the true boxes, in order, of the best overlap among boxes not yet taken; the first of equals is taken, none if nothing overlaps."""

    def step(acc: Column, g: Column) -> Column:
        scores = F.transform(acc["left"], lambda r: iou(r, g))
        best = F.coalesce(F.array_max(scores), F.lit(0.0))
        at = F.array_position(scores, best)
        left = F.when(best > 0, F.filter(acc["left"], lambda r, i: i != (at - 1).cast("int"))).otherwise(acc["left"])
        return F.struct(left.alias("left"), (acc["sum"] + best).alias("sum"))

    start = F.struct(found.alias("left"), F.lit(0.0).alias("sum"))
    total = F.aggregate(truth, start, step, lambda acc: acc["sum"])
    return F.when(F.size(truth) > 0, F.bround(total / F.size(truth), 3))


def measured_fonts(blocks: DataFrame, spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, block_no, type, bbox) with fs, bold and vertical from the spans whose centre lies in the box, 3 points of slack around it.

    fs is the size at which the running count of characters reaches half, in hundredths of the page's width.
    """
    size = pages.select("doc_id", "page", "w_pt", "h_pt")
    area = blocks.filter((F.col("type") != "image") & (F.size("bbox") == 4)).join(size, ["doc_id", "page"])
    pt = lambda i, side: F.col("bbox")[i] / F.lit(999.0) * F.col(side)
    area = area.select("doc_id", "page", "block_no", "w_pt", (pt(0, "w_pt") - 3).alias("l"), (pt(1, "h_pt") - 3).alias("t"), (pt(2, "w_pt") + 3).alias("r"), (pt(3, "h_pt") + 3).alias("b"))
    own = spans.withColumn("n", F.length(F.trim("text"))).filter("n > 0 and size > 0").select("doc_id", "page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "size", "n", "dir_y", ((F.col("flags").bitwiseAND(16) != 0) | F.lower("font").contains("bold")).alias("heavy"))
    met = area.join(own, ["doc_id", "page"]).filter("cx between l and r and cy between t and b")
    box = Window.partitionBy("doc_id", "page", "block_no")
    met = met.withColumn("run", F.sum("n").over(box.orderBy("size", "n").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(box))
    chars = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    up, down = chars(F.col("dir_y") < -0.7), chars(F.col("dir_y") > 0.7)
    fonts = met.groupBy("doc_id", "page", "block_no").agg(
        (F.min(F.when(F.col("run") * 2 >= F.col("total"), F.col("size"))) / F.first("w_pt") * 100).alias("fs"),
        (chars(F.col("heavy")) * 2 > F.sum("n")).alias("bold"),
        F.when((up + down) * 2 > F.sum("n"), F.when(up >= down, "up").otherwise("down")).alias("vertical"),
    )
    return blocks.join(fonts, ["doc_id", "page", "block_no"], "left")
