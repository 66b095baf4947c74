"""What every operator of this subpackage shares: the shared folder, written tables, shipping of this package."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, so that their Python can import it. The driver serves the archive from its own folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="quire-ship-")
    target = os.path.join(folder, "quire_shipped.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.join("quire", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset a local session gets one of its own, any other an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving back its memory at the end of each task: Python workers outlive tasks and stages."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return held


def trim() -> None:
    """Give memory that is free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def written(df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write df to a table in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def new_folder(spark: SparkSession, path: str) -> str:
    """Make a folder in any store that Spark reaches."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path


def discard(*frames: DataFrame) -> None:
    """Delete tables of written() that no returned frame reads any more."""
    for df in frames:
        path = getattr(df, "_quire_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with its columns named in keep and all others in one struct, so that no name of theirs meets one of ours; and what puts them back.

    The second takes a frame with those columns, and names of its own columns to be added behind them; they replace old ones of these names.
    """
    names = df.columns
    rest = [c for c in names if c not in keep]
    held = df.select(*[c for c in keep if c in names], *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("quire_rest")] if rest else []))

    def back(out: DataFrame, *added: str) -> DataFrame:
        return out.select(*[F.col(f"quire_rest.`{c}`").alias(c) if c in rest else F.col(c) for c in names if c not in added], *added)

    return held, back


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def row_key(last: bool = False, doc_id: str = "doc_id", text: str = "text"):
    """doc_id as a long; a row without one has a hash of its text, from -2**63 to -2**62 - 1, or with last from 2**62 to 2**63 - 1."""
    h = F.xxhash64(F.col(text).cast("string")).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col(doc_id).cast("long"), h + F.lit(1 << 62) if last else h + F.lit(-(1 << 63)))

