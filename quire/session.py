"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str = "local[*]", **more: str) -> SparkSession:
    return SparkSession.builder.master(master).config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).getOrCreate()
