"""Running sums and numbers over a whole table in order, without one task that sees all of it.

The table is cut into ranges of the order, each range is summed, the sums before
each range are handed to it, and the running value is worked out within ranges.
Sums by group take the group into the order: a group that spans ranges gets the
sums of its earlier ranges, and there are no more such entries than twice the
ranges, however many groups there are. So neither a table without groups nor a
group of any size is a hot key; only rows that are equal in the whole order share
a task, so an order ends in a key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.sources import commits


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], group: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with the running sum of each of ``sums`` in ``order``, from the start of the table or of the row's group.

    Sums are of whole numbers or decimals, so that they do not depend on where ranges end; null counts as 0.
    """
    spark, group = df.sparkSession, group or []
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__{k}") for k, c in sums.items()])
    # written, as ranges are drawn by sampling and two passes could draw them differently
    path = f"{commits.workspace(spark)}/ranges-{uuid.uuid4().hex}"
    cut.repartitionByRange(n, *[F.asc(g) for g in group], *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.schema(cut.withColumn("__range", F.lit(0)).schema).parquet(path)
    totals = cut.groupBy("__range", *group).agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    spans = totals.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("__range", *[F.coalesce(f"__{k}", F.lit(0)).alias(k) for k in sums]))).alias("s")).where(F.size("s") > 1)
    before = lambda k: F.reduce(F.slice("s", 1, F.col("i")), F.lit(0).cast(_kind(cut, k)), lambda a, x: (a + x[k]).cast(_kind(cut, k))).alias(f"__before_{k}")
    offsets = spans.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "s", F.posexplode("s").alias("i", "x")).where("i > 0")
    offsets = offsets.select(*[f"__g{i}" for i in range(len(group))], F.col("x.__range").alias("__r"), *[before(k) for k in sums])
    same = cut["__range"] == offsets["__r"]
    for i, g in enumerate(group):
        same = same & cut[g].eqNullSafe(offsets[f"__g{i}"])
    # at most two entries a range: its first group, and its last
    placed = cut.join(F.broadcast(offsets), same, "left")
    within = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(*df.columns, *[(F.sum(f"__{k}").over(within) + F.coalesce(f"__before_{k}", F.lit(0))).alias(k) for k in sums])


def _kind(df: DataFrame, name: str) -> str:
    """The type in which a column is summed."""
    return df.agg(F.sum(f"__{name}").alias("s")).schema["s"].dataType.simpleString()


def numbered(df: DataFrame, order: list[Column], name: str = "n", group: list[str] | None = None) -> DataFrame:
    """``df`` with row numbers from 1 in ``order``."""
    return running(df, order, {name: F.lit(1).cast("long")}, group)
