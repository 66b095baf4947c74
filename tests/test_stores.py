"""The keyed store, headers of images, routes of pages."""

import os
import random
import struct

from pyspark.sql import functions as F

from quire.operators import route
from quire.plans import stage
from quire.sources import images, store


def parts(folder):
    base = folder.removeprefix("file://")
    return {(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_keep_the_latest_and_leave_other_buckets_alone(spark):
    rng, want = random.Random(5), {}
    own = store.Store(spark, stage.fresh(spark, "test-store"), "id long, text string, at long", ["id"], "at", buckets=16)
    for turn in range(4):
        changes = [(rng.randrange(12), f"t{turn}-{n}", rng.randrange(40)) for n in range(5)]
        gone = [(rng.randrange(12), rng.randrange(40)) for _ in range(2)]
        own.upsert(spark.createDataFrame(changes, "id long, text string, at long"))
        first = {}
        for i, text, at in changes:
            if i not in first or at > first[i][0]:
                first[i] = (at, text)
        for i, (at, text) in first.items():
            if sum(c[0] == i and c[2] == at for c in changes) == 1 and (i not in want or at > want[i][0]):
                want[i] = (at, text)
            elif i not in want or at > want[i][0]:
                want[i] = (at, None)
        own.delete(spark.createDataFrame(gone, "id long, at long"))
        for i, at in gone:
            if i not in want or at > want[i][0]:
                want[i] = (at, "gone")
    got = {r.id: (r.at, r.text) for r in own.read().collect()}
    assert got.keys() == {i for i, (_, t) in want.items() if t != "gone"}
    assert all(got[i][0] == at and t in (None, got[i][1]) for i, (at, t) in want.items() if t != "gone")
    some = next(iter(got))
    assert rows(own.get(id=some)) == [(some, got[some][1], got[some][0])] and rows(own.get(id=99)) == []
    before = parts(own.folder)
    own.upsert(spark.createDataFrame([(some, "new", 1000)], "id long, text string, at long"))
    after = parts(own.folder)
    assert len({d for d, _ in before ^ after}) == 1 and rows(own.get(id=some)) == [(some, "new", 1000)]


def test_an_older_row_does_not_undo_a_deletion_until_it_is_cleared(spark):
    own = store.Store(spark, stage.fresh(spark, "test-store"), "id string, at long", ["id"], "at", buckets=4)
    one = lambda at: spark.createDataFrame([("a", at)], "id string, at long")
    own.upsert(one(1)), own.delete(one(5)), own.upsert(one(3))
    assert rows(own.read()) == []
    own.clear(F.lit(6))
    assert own._rows().count() == 0 and rows(own.read()) == []
    own.upsert(one(2))
    assert rows(own.read()) == [("a", 2)]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", w, h, 8, 2, 0, 0, 0)


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(w, h, *before, frame=0xC0):
    return b"\xff\xd8" + b"".join(before) + segment(frame, struct.pack(">BHHB", 8, h, w, 3)) + b"\xff\xda"


def test_headers(spark):
    files = {
        png(640, 480): ("PNG", 640, 480, ""), png(8000, 8000): ("PNG", 8000, 8000, "pixels"), png(0, 5): ("PNG", 0, 5, "format"), png(1, 1)[:20]: (None, None, None, "format"), b"GIF89a": (None, None, None, "format"), b"": (None, None, None, "format"),
        jpeg(100, 200): ("JPEG", 100, 200, ""), jpeg(3, 4, segment(0xE0, b"JFIF" * 9), segment(0xFE, b"\xff\xc0" * 300), segment(0xC4, b"x")): ("JPEG", 3, 4, ""), jpeg(5, 6, b"\xff\x01", b"\xff\xff\xff", frame=0xCE): ("JPEG", 5, 6, ""),
        b"\xff\xd8" + segment(0xDB, b"x") + b"\xff\xd9": (None, None, None, "format"), b"\xff\xd8\x00\x00": (None, None, None, "format"), b"\xff\xd8": (None, None, None, "format"), jpeg(7, 8, *[segment(0xE1, b"y" * 60_000)] * 9): ("JPEG", 7, 8, ""),
    }
    df = spark.createDataFrame([(bytearray(f),) for f in files], "f binary").withColumn("h", images.header(F.col("f")))
    got = {bytes(r.f): (r.h.format, r.h.width, r.h.height, r.r) for r in df.withColumn("r", images.refusal(F.length("f"), F.col("h"))).collect()}
    assert got == files
    assert df.limit(1).select(images.refusal(F.lit(200 << 20), F.col("h"))).first()[0] == "size"


def test_routes(spark):
    loop = "".join(f"item number {i} of this long repeated line of text\n" for i in range(80))
    chunks = spark.createDataFrame([(1, 0, 1, 2, False), (1, 1, 3, 2, False), (1, 2, 5, 1, False), (2, 0, 1, 1, True)], "doc_id long, chunk int, first_page int, num_pages int, single boolean")
    multi = spark.createDataFrame([(1, 0, 1, None, "e1"), (1, 0, 2, "<PAGE>a ![](images/page_1_0.jpg)<PAGE>b", None), (1, 1, 1, f"<PAGE>c<PAGE>{loop}", None), (1, 2, 1, None, "e2"), (1, 2, 2, None, "x" * 300)], "doc_id long, chunk int, attempt int, text string, error string")
    single = spark.createDataFrame([(1, 3, 1, " one ", None), (1, 4, 1, loop, None), (1, 4, 2, "never", None), (2, 1, 1, None, "e3"), (2, 1, 2, None, "e4")], "doc_id long, page int, attempt int, text string, error string")
    layers = spark.createDataFrame([(1, 4, "layer\r\ntext"), (2, 1, "...")], "doc_id long, page int, text string")
    pages, warnings = route.routed(chunks, multi, single, layers)
    assert rows(pages) == [
        (1, 1, "a ![](images/page_1_0.jpg)".replace("page_1_0", "p0002_0"), "multi"), (1, 2, "b", "multi"), (1, 3, "one", "single"), (1, 4, "    layer\n    text", "text_layer"), (1, 5, route.FAILED, "placeholder"), (2, 1, route.FAILED, "placeholder"),
    ]
    assert rows(warnings) == [(1, 3, 4, "reread", "line_repeat"), (1, 4, 4, "text_layer", "line_repeat"), (1, 5, 5, "placeholder", "x" * 200), (2, 1, 1, "placeholder", "e4")]
