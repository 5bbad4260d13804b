"""Session with the settings that the queries rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessaro", **conf: str) -> SparkSession:
    """UTC times and adaptive execution; anything else is the cluster's own choice."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
