"""Streams with keyed state: rows in any batch and order, timers, restarts."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import render
from quire.streaming import coalesce, expiry, ordered, pages, preview, run

RAW = (
    "<|ref|>Image <|/ref|><|det|>[[1, 2, 3, 4], [5,6,7,8]]<|/det|>under it<PAGE>", "<|det|>title [1, 2, 3, 4]<|/det|>Two\n  lines<|det|>page-number [1,2,3,4]<|/det|>7<PAGE><PAGE>",
    "<|det|>text [1,2,3,4]<|/det|> a <|x|> b < c <|d", "<|ref|>x<|/ref|><|det|>[[1,2", "plain <PA", "<|det|>image [1,2,3,4]<|/det|><|det|>equation [1,2,3,4]<|/det|>\\( x \\)<PAGE>---<PAGE>z",
)


@pytest.mark.parametrize("raw", RAW)
def test_what_is_shown_and_what_waits_are_the_text(raw):
    for cut in range(len(raw) + 1):
        text = raw[:cut]
        at = preview.unfinished(text)
        kept, held = text[:at], text[at:]
        assert kept + held == text
        bare = preview._TAG.sub("", kept)
        assert not any(bare.endswith(x[:k]) for x in preview.LITERALS for k in range(1, len(x)))
    assert preview.unfinished("a<|" + "x" * 3000) == 3003


def test_a_page_in_python_is_the_page_in_columns(spark):
    texts = [t for raw in RAW for t in raw.split("<PAGE>")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", render.preview(F.col("t")).alias("p")).collect():
        assert preview.shown(r.t, True).removesuffix("---").rstrip() == r.p.removesuffix("---").rstrip()


def test_previews_emit_each_page_once_and_tails_only_when_they_change(spark):
    text = "<PAGE>".join(RAW)
    deltas = [(1, k, text[at : at + 7], at + 7 >= len(text)) for k, at in enumerate(range(0, len(text), 7))]
    random.Random(4).shuffle(deltas)
    stream = run.staged(spark.createDataFrame(deltas, "doc_id long, seq int, delta string, last boolean"), 5, "seq")
    rows = run.drained(preview.preview(stream), "append").collect()
    done = sorted((r.page, r.md, r.ruled) for r in rows if r.kind == "page")
    want, before = [], False
    for k, page in enumerate(text.split("<PAGE>")):
        md = preview.shown(page, True)
        want.append((k, md, bool(md) and before))
        before = before or bool(md)
    assert done == want
    tails = [(r.page, r.md, r.ruled) for r in sorted((r for r in rows if r.kind == "tail"), key=lambda r: r.batch)]
    assert all(a != b for a, b in zip(tails, tails[1:]))


def fed(spark, tmp_path, rows):
    """A stream of files, to which more can be put while it runs."""
    schema = "doc_id long, seq int, delta string, last boolean"
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(schema).parquet(folder), lambda more: spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(folder)


def test_events_by_size_and_by_the_clock_cut_no_marker(spark, tmp_path):
    stream, put = fed(spark, tmp_path, [(1, 0, "x" * 300, False), (1, 1, "short <PA", False), (2, 0, "<", False)])
    seen = []
    with run.settings(spark):
        query = coalesce.coalesced(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").foreachBatch(lambda df, n: seen.extend(df.collect())).start()
        until(lambda: len(seen) == 2)
        put([(1, 2, "GE> then", False), (2, 1, "PAGE>", True)])
        until(lambda: len(seen) == 4)
        query.stop()
    got = {(r.doc_id, r.event): (r.text, r.page, r.why) for r in seen}
    assert got == {(1, 0): ("x" * 300 + "short ", 0, "size"), (1, 1): ("<PAGE> then", 1, "time"), (2, 0): ("<PAGE>", 1, "end")} or got == {(1, 0): ("x" * 300, 0, "size"), (1, 1): ("short ", 0, "time"), (1, 2): ("<PAGE> then", 1, "time"), (2, 0): ("<PAGE>", 1, "end")}


def until(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.1)
    assert done()


def test_a_late_touch_revives_and_open_jobs_stay(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    rows = [(1, day(1), "done"), (2, day(1), "done"), (2, day(6), None), (3, day(1), "running"), (4, day(1), "running"), (4, day(2), "error"), (5, day(10), "done"), (6, day(3), "error"), (6, day(1), "running")]
    df = spark.createDataFrame(rows, "id long, at string, status string").withColumn("at", F.col("at").cast("timestamp"))
    out = run.drained(expiry.expired(run.staged(df, 1), F.expr("interval 5 days")), "append")
    assert sorted((r.id, r.status, r.touched_at.day) for r in out.collect()) == [(1, "done", 1), (4, "error", 2), (6, "error", 3)]


def test_a_stream_that_breaks_off_goes_on(spark):
    deltas = spark.createDataFrame([(d, k, f"<|det|>text [{k}, 0, {k + 5}, 9]<|/det|>", k == 19) for d in range(3) for k in range(20)], "doc_id long, seq int, delta string, last boolean")
    stream, sink = run.staged(deltas, 4, "seq"), run.Sink(spark, run.fresh(spark, "test"))
    for stop in (0, 2, None):
        sink.run(pages.stream_boxes(stream), "append", until=stop)
    rows = sink.rows().collect()
    assert sorted((r.doc_id, r.n, r.box) for r in rows) == [(d, k, f"{k},0,{k + 5},9") for d in range(3) for k in range(20)]
    assert {r.batch for r in sink.rows(since=1).collect()} <= {2, 3}


def test_rows_that_come_again_are_left_out(spark):
    rows = [(1, 1, "b", False), (1, 0, "a", False), (1, 0, "a", False), (1, 3, "d", True), (1, 2, "c", False), (1, 2, "c", False)]
    out = run.drained(preview.preview(run.staged(spark.createDataFrame(rows, "doc_id long, seq int, delta string, last boolean"), 3, "delta")), "append")
    assert [r.md for r in out.filter("kind = 'page'").collect()] == ["abcd"]


def test_what_expires_does_not_hang_on_the_batches(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    # 1 has gone by the time of its second touch, which says nothing; 2 is touched in time
    rows = [(1, day(1), "done"), (1, day(9), None), (2, day(1), "done"), (2, day(4), None), (3, day(20), "running")]
    df = spark.createDataFrame(rows, "id long, at string, status string").withColumn("at", F.col("at").cast("timestamp"))
    out = run.drained(expiry.expired(run.staged(df, 1), F.expr("interval 5 days")), "append")
    assert sorted((r.id, r.status, r.touched_at.day) for r in out.collect()) == [(1, "done", 1), (2, "done", 4)]


class Counted:
    """A state that counts the trips to it."""

    def __init__(self, trips):
        self.value, self.trips = None, trips

    def trip(self, value=None):
        self.trips.append(1)
        return value

    def exists(self):
        return self.trip(self.value is not None)

    def get(self):
        return self.trip(self.value)

    def update(self, value):
        self.value = self.trip(value)

    put = update

    def appendValue(self, value):
        self.value = self.trip([*(self.value or []), value])

    def clear(self):
        self.value = self.trip()


def test_a_batch_of_a_key_makes_few_trips_to_the_state():
    trips = []

    class Handle:
        def getValueState(self, name, schema):
            return Counted(trips)

        getListState = getMapState = getValueState

    class Plain(ordered.Ordered):
        def handleInputRows(self, key, rows, timerValues):
            return iter([])

    own, got, order = Plain(), [], list(range(1000))
    own.init(Handle())
    random.Random(2).shuffle(order)
    for at in range(0, 1000, 250):
        came = [*order[at : at + 250], *order[at : at + 9]]
        before = len(trips)
        got += [(r["seq"], r["delta"]) for r in own.in_order(iter([pd.DataFrame({"seq": came, "delta": [str(s) for s in came]})]))]
        assert len(trips) - before <= 5
    assert got == [(s, str(s)) for s in range(1000)]


def test_a_batch_of_a_key_reads_and_writes_its_state_once():
    trips, got, order = [], [], list(range(1000))

    class Handle:
        def getValueState(self, name, schema):
            return Counted(trips)

    own = ordered.Keyed(lambda key, state, rows, now: ((state[0] + len(rows),), [(key, state[0], *r) for r in rows]), ["doc_id", "before", "delta"], "n int", (0,), False)
    own.init(Handle())
    random.Random(2).shuffle(order)
    for at in range(0, 1000, 250):
        came = [*order[at : at + 250], *order[at : at + 9]]
        before = len(trips)
        out = list(own.handleInputRows((7,), iter([(7, s, str(s)) for s in came]), None))
        assert len(trips) - before == 2 and {r.before for r in out} <= {len(got)}
        got += [(r.doc_id, r.delta) for r in out]
    assert got == [(7, str(s)) for s in range(1000)]
