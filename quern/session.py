"""Sessions with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "quern", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings stay as the cluster has them."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
