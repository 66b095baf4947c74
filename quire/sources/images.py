"""What the header of an image says, without decoding it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# The sizes that are let through; how a PNG begins; the markers of a JPEG's frames, and those that have no length.
MOST_MB, MOST_PIXELS = 128, 60_000_000
PNG, JPEG = "89504E470D0A1A0A", "FFD8"
FRAMES = tuple(f"C{x}" for x in "012356789ABDEF")
BARE = ("01", *(f"D{k}" for k in range(8)))
#: Segments that are walked through at most, and how much of a file is looked at: a frame's header stands near the beginning.
SEGMENTS, HEAD = 256, 1 << 20


def number(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("long")


def jpeg_size(hexed: Column) -> Column:
    """struct of width and height from a file's bytes in hex: segments are walked from marker to marker up to the first frame; null without one."""
    byte = lambda at, n=1: F.substring(hexed, at * 2 + 1, F.lit(2 * n))
    start = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("height"), F.lit(None).cast("long").alias("width"), F.lit(False).alias("over"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"].cast("int")
        marker = byte(at + 1)
        frame, lost = marker.isin(*FRAMES), (byte(at) != "FF") | marker.isin("D9", "DA", "")
        skip = F.when(marker == "FF", 1).when(marker.isin(*BARE), 2).otherwise(number(byte(at + 2, 2)) + 2)
        moved = F.struct(
            F.when(frame | lost, s["at"]).otherwise(s["at"] + F.coalesce(skip, F.lit(2))).cast("long").alias("at"), F.when(frame & ~lost, number(byte(at + 5, 2))).alias("height"),
            F.when(frame & ~lost, number(byte(at + 7, 2))).alias("width"), (frame | lost).alias("over"),
        )
        return F.when(s["over"], s).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)
    return T.let(end, lambda s: F.when(s["width"].isNotNull(), F.struct(s["width"].alias("width"), s["height"].alias("height"))))


def header(content: Column) -> Column:
    """struct of format ('PNG', 'JPEG' or null), width and height of a file's bytes."""

    def read(hexed: Column) -> Column:
        png = hexed.startswith(PNG) & (F.substring(hexed, 25, 8) == "49484452") & (F.length(hexed) >= 48)
        jpeg = F.when(hexed.startswith(JPEG), jpeg_size(hexed))
        size = F.when(png, F.struct(number(F.substring(hexed, 33, 8)).alias("width"), number(F.substring(hexed, 41, 8)).alias("height"))).otherwise(jpeg)
        return T.let(size, lambda s: F.struct(F.when(png, "PNG").when(s.isNotNull(), "JPEG").alias("format"), s["width"].alias("width"), s["height"].alias("height")))

    return T.let(F.hex(F.substring(content, 1, HEAD)), read)


def refusal(length: Column, head: Column, most_mb: int = MOST_MB, most_pixels: int = MOST_PIXELS) -> Column:
    """Why a file isn't let through ('' if it is): 'size', 'format' (neither PNG nor JPEG, or no readable header) or 'pixels'."""
    return F.when(length > most_mb * 1024 * 1024, "size").when(head["format"].isNull() | (F.least(head["width"], head["height"]) < 1), "format").when(head["width"] * head["height"] > most_pixels, "pixels").otherwise("")
