"""Facet counts from stored bitmaps (A1, A2, A4, F11): the rows are read once, whatever filters are set later.

Each row gets a number; for each value of each facet the numbers of the rows that
have it are a bitmap, cut into buckets of 32,768 rows. A filter set is then
boolean algebra on bitmaps, bucket by bucket and distributed by bucket:

    a facet passes where any of its wanted values is   (or)
    a row passes all filters where all facets do       (and)
    a facet is counted where all other facets pass     (and), its own does not count

and so are near misses: rows that pass all filters but one, less those that pass all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.facets import Facet, Filters
from quern.sources import commits

#: The bitmap of all rows; the counts of totals and near misses (as in :mod:`facets`).
ALL = "#all"


def build(df: DataFrame, facets: dict[str, Facet], root: str, source: str | None = None) -> DataFrame:
    """Commit the bitmaps of ``df`` as the current version of ``root``: (key, value, bucket, bits)."""
    spark = df.sparkSession

    def write(folder: str) -> None:
        listed = lambda f: F.array_distinct(F.array_compact(F.coalesce(f.value, F.array()).cast("array<string>"))) if f.is_array else F.array_compact(F.array(f.value.cast("string")))
        # written with its numbers: a task that runs again would number its rows anew
        df.select(F.monotonically_increasing_id().alias("n"), *[listed(f).alias(k) for k, f in facets.items()]).write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        entry = lambda k: F.transform(k, lambda v: F.struct(F.lit(k).alias("key"), v.alias("value")))
        each = rows.select("n", F.inline(F.concat(F.array(F.struct(F.lit(ALL).alias("key"), F.lit("").alias("value"))), *[entry(k) for k in facets])))
        bits = each.groupBy("key", "value", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
        bits.repartition("bucket").sortWithinPartitions("key", "value").write.parquet(f"{folder}/bits")

    commits.commit(spark, root, write, {"source": source})
    return commits.read(spark, root, "bits")


def current(spark: SparkSession, root: str, source: str) -> DataFrame | None:
    """The bitmaps committed last, if they are of this source."""
    v = commits.current(spark, root)
    return commits.read(spark, root, "bits") if v and v.properties.get("source") == source else None


def counts(bits: DataFrame, keys: list[str], filters: Filters) -> DataFrame:
    """(key, value, n) as :func:`facets.facet_counts` gives them, from bitmaps alone."""
    wanted = {k: v for k, v in filters.wanted.items() if k in keys and v}
    passed = [bits.where((F.col("key") == k) & F.col("value").isin(v)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("passes", F.lit(k)) for k, v in wanted.items()]
    everything = bits.where(F.col("key") == ALL).select("bucket", "bits", F.lit(ALL).alias("passes"))
    passed = reduce(lambda a, b: a.unionByName(b), [everything, *passed])
    # for each mask the facets that have to pass: all, or all but one; a bucket that one of them lacks is empty
    masks = {"#total": [ALL, *wanted]} | {k: [ALL, *(j for j in wanted if j != k)] for k in wanted}
    names = F.array(*[F.when(F.col("passes").isin(need), F.lit(m)) for m, need in masks.items()])
    size = F.create_map(*[F.lit(x) for m, need in masks.items() for x in (m, len(need))])
    mask = passed.select("bucket", "bits", F.explode(F.array_compact(names)).alias("mask")).groupBy("mask", "bucket").agg(F.bitmap_and_agg("bits").alias("allowed"), F.count("*").alias("m"))
    mask = mask.where(F.col("m") == F.try_element_at(size, F.col("mask"))).drop("m")
    # a facet without a filter is counted under all of them
    used = F.when(F.col("key").isin([*wanted]), F.col("key")).otherwise(F.lit("#total"))
    met = bits.where(F.col("key").isin(keys)).withColumn("mask", used).join(mask, ["mask", "bucket"])
    both = met.select("key", "value", "bucket", F.explode(F.array("bits", "allowed")).alias("b")).groupBy("key", "value", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("b")).alias("n"))
    facet_rows = both.groupBy("key", "value").agg(F.sum("n").alias("n"))
    sizes = mask.groupBy("mask").agg(F.sum(F.bitmap_count("allowed")).alias("n"))
    # a near miss passes all but one filter and not all; one row per filter at most, so the total is handed down by a join of a single row
    total = sizes.where("mask = '#total'").select(F.col("n").alias("passing"))
    near = sizes.where("mask <> '#total'").join(total, F.lit(True), "left").select(F.lit("#near").alias("key"), F.col("mask").alias("value"), (F.col("n") - F.coalesce("passing", F.lit(0))).alias("n"))
    all_ = sizes.where("mask = '#total'").select(F.lit("#total").alias("key"), F.lit("").alias("value"), "n")
    return facet_rows.unionByName(all_).unionByName(near).where("n > 0")
