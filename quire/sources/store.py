"""A keyed table that is written anew where it changes: upserts by buckets, deletions as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quire.plans.stage import staged


class Store:
    """Rows of a schema, one for each key, dealt into buckets by the key's hash.

    An upsert reads and writes the buckets of its keys only. Of rows with one key the latest by version stays, whichever
    comes first; of equal versions the one that is there. A deletion is a row that is marked and hidden, so that an older
    row that comes late does not bring the key back; clear() drops such rows. What replaces a bucket is written whole
    before the bucket is touched, and an upsert that was cut off can be made again: it gives the same rows.
    """

    GONE, BUCKET = "store_gone", "store_bucket"

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, key: list[str], version: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.version, self.buckets = spark, folder.rstrip("/"), key, version, buckets
        self.names = spark.createDataFrame([], schema).schema.fields
        self.schema = StructType([*self.names, StructField(self.GONE, BooleanType())])
        self._with_bucket(spark.createDataFrame([], self.schema)).write.mode("append").partitionBy(self.BUCKET).parquet(self.folder)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.BUCKET, self._bucket())

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, *self._with_bucket(self.spark.createDataFrame([], self.schema)).schema.fields[-1:]])).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._rows().filter(~F.col(self.GONE)).select(*[f.name for f in self.names])

    def get(self, **key) -> DataFrame:
        """The row of one key: one bucket is looked into."""
        wanted = self.spark.createDataFrame([tuple(key[k] for k in self.key)], StructType([f for k in self.key for f in self.names if f.name == k]))
        bucket = wanted.select(self._bucket()).first()[0]
        return self._rows().filter((F.col(self.BUCKET) == bucket) & ~F.col(self.GONE)).join(F.broadcast(wanted), self.key, "left_semi").select(*[f.name for f in self.names])

    def upsert(self, changes: DataFrame) -> None:
        self._merge(changes.select(*[F.col(f.name).cast(f.dataType) for f in self.names], F.lit(False).alias(self.GONE)))

    def delete(self, keys: DataFrame) -> None:
        """Marks keys (the key columns and the version of the deletion)."""
        have = {*self.key, self.version}
        self._merge(keys.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.names], F.lit(True).alias(self.GONE)))

    def clear(self, before: Column) -> None:
        """Drops the marks of deletions with a version under before."""
        old = F.col(self.GONE) & (F.col(self.version) < before)
        rows = self._rows()
        touched = [r[0] for r in rows.filter(old).select(self.BUCKET).distinct().collect()]  # no more than there are buckets
        # a bucket that loses all of its rows is replaced too: by its rows and by nothing else
        self._replace(rows.filter(F.col(self.BUCKET).isin(touched) & ~old), touched)

    def _merge(self, changes: DataFrame) -> None:
        changes = staged(self._with_bucket(changes), "store-changes")
        touched = [r[0] for r in changes.select(self.BUCKET).distinct().collect()]  # no more than there are buckets
        held = self._rows().filter(F.col(self.BUCKET).isin(touched)).withColumn("store_held", F.lit(1))
        both = held.unionByName(changes.withColumn("store_held", F.lit(0)))
        rest = [c for c in both.columns if c not in self.key and c != "store_held"]
        best = both.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.struct(self.version, "store_held")).alias("store_row"))
        self._replace(best.select(*self.key, "store_row.*").select(*changes.columns), touched)

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        new = staged(rows, "store-buckets")
        kept = {r[0] for r in new.select(self.BUCKET).distinct().collect()}
        new.repartition(self.BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.BUCKET).parquet(self.folder)
        for bucket in set(touched) - kept:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.BUCKET}={bucket}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
