"""Run a stream over what is there, all at once or from where it stopped, and read its results."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.stage import fresh

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream of files with the table's schema. Only a pattern may name a single file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def staged(df: DataFrame, batches: int, *by: str) -> DataFrame:
    """A frame as a stream of so many batches, dealt by these columns: rows of one key may come in any batch and in any order."""
    spark, path = df.sparkSession, fresh(df.sparkSession, "staged")
    df.repartition(batches, *by).write.option("maxRecordsPerFile", 0).parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Keyed state in RocksDB, a store for each core; the session's own settings come back."""
    names = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class BrokenOff(Exception):
    """A stream was asked to end in the midst of its work."""


class Sink:
    """A folder that takes a stream's rows exactly once, over any number of starts.

    Batches are written under their numbers, so one that is run again replaces itself. The checkpoint beside them says
    where a later start goes on; it belongs to one query, with which it must be started again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def run(self, stream: DataFrame, mode: str, until: int | None = None, timed: bool = False) -> None:
        """Takes what is there now; with until it breaks off in that batch, when its rows are written and before it counts as done.

        A stream with timers of the clock (timed) never runs out of batches: it ends behind the first one without input.
        """

        def put(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
            if batch == until:
                raise BrokenOff(f"batch {batch}")

        with settings(self.spark):
            writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(put)
            if not timed:
                try:
                    writer.trigger(availableNow=True).start().awaitTermination()
                except StreamingQueryException as error:
                    if until is None or BrokenOff.__name__ not in str(error):
                        raise
                return
            query = writer.trigger(processingTime="200 milliseconds").start()
            while query.isActive and (query.lastProgress or {}).get("numInputRows", 1):
                time.sleep(0.1)
            query.stop()
            if query.exception():
                raise query.exception()

    def rows(self, since: int = -1) -> DataFrame:
        """All rows with their batch, or those behind a batch that a reader has seen."""
        out = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows/batch=*")
        return out.filter(F.col("batch") > since)


def drained(stream: DataFrame, mode: str, timed: bool = False) -> DataFrame:
    """All rows that the stream emits for its present input, with the number of the batch."""
    sink = Sink(stream.sparkSession, fresh(stream.sparkSession, "stream"))
    sink.run(stream, mode, timed=timed)
    return sink.rows()
