"""Layout: cutting pages, slicing images and packing a wall of frames."""

from __future__ import annotations

from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The sliver that is not worth a cut, and how far packing looks ahead.
SLIVER, LOOK_AHEAD = 0.02, 24


def cut_blocks(df: DataFrame, keys: list[str], order: list[str], ratio: str, cap: float) -> DataFrame:
    """Blocks up to a total height ratio: the crossing one is cut, slivers and what follows go."""
    before = F.coalesce(F.sum(ratio).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = df.withColumn("top", before).withColumn("shown", F.least(F.col(ratio), F.lit(cap) - F.col("top")))
    return rows.where((F.col("shown") >= SLIVER) | ((F.col("shown") > 0) & (F.col("shown") == F.col(ratio))))


def slices(df: DataFrame, height: str, step: int, keep: list[str]) -> DataFrame:
    """(index, top, height) of the slices of an image, which meet without gaps."""
    tops = F.sequence(F.lit(0), F.col(height).cast("int") - 1, F.lit(step))
    rows = df.where(F.col(height) > 0).select(*keep, F.col(height).alias("__h"), F.posexplode(tops).alias("index", "top"))
    return rows.select(*keep, "index", "top", F.least(F.lit(step), F.col("__h") - F.col("top")).cast("int").alias("slice_height"))


def wall_grid(df: DataFrame, group: list[str], order: list[str], columns: int, width: int, height: int, gap: int) -> DataFrame:
    """x, y, row and column of frames of one size, in order."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    out = df.withColumn("__n", n).withColumn("row", F.floor(F.col("__n") / columns).cast("int")).withColumn("column", (F.col("__n") % columns).cast("int"))
    return out.withColumn("x", F.col("column") * (width + gap)).withColumn("y", F.col("row") * (height + gap)).drop("__n")


def visible(df: DataFrame, y: str, height: str, top: Column | float, bottom: Column | float) -> DataFrame:
    """Frames that meet [top, bottom)."""
    return df.where((F.col(y) < bottom) & (F.col(y) + F.col(height) > top))


def wall_pack(df: DataFrame, group: str, order: str, width: str, row_width: int, gap: int) -> DataFrame:
    """row and x of frames of different widths, packed greedily.

    A row takes the next frame that still fits among the next ``LOOK_AHEAD``;
    the fold is ordered, so a group is packed in one task: groups are walls.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        widths, later = rows[width].tolist(), iter(range(len(rows)))
        ahead = list(islice(later, LOOK_AHEAD))  # only these are looked at, so a wall takes linear time
        place: dict[int, tuple[int, int]] = {}
        row = x = 0
        while ahead:
            fit = next((k for k, i in enumerate(ahead) if x == 0 or x + widths[i] <= row_width), None)
            if fit is None:
                row, x = row + 1, 0
                continue
            i = ahead.pop(fit)
            ahead += islice(later, 1)
            place[i] = (row, x)
            x += widths[i] + gap
        return rows.assign(row=[place[i][0] for i in range(len(rows))], x=[place[i][1] for i in range(len(rows))]).astype({"row": "int32", "x": "int64"})

    schema = df.drop("row", "x").schema.simpleString()[7:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("row", "x").schema)
    return df.drop("row", "x").groupBy(group).applyInPandas(pack, f"{fields}, row int, x long") if schema else df


def page_view_ratio(view_width: Column, view_height: Column, block_ratio_sum: Column) -> Column:
    """Height over width of a page: its own, else the sum of its blocks'."""
    return F.coalesce(view_height / F.nullif(view_width, F.lit(0)), block_ratio_sum)


def synthetic(spark, rows: int, partitions: int | None = None, seed: int = 7) -> DataFrame:
    """A deterministic wall of ``rows`` blocks for scale tests (S22): seeded hashes, no random numbers."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")
    kinds = ("hero", "faq", "footer", "product-card", "newsletter", "video")
    return base.select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("store"), pick("host", max(1, rows // 30)).cast("string"), F.lit(".example")).alias("host"),
        F.element_at(F.array(*map(F.lit, kinds)), pick("kind", len(kinds)) + 1).alias("block_type"),
        F.element_at(F.array(F.lit("desktop"), F.lit("mobile")), pick("view", 2) + 1).alias("viewport"),
        (F.lit(400) * (0.75 + pick("height", 501) / 1000)).cast("int").alias("height"),
        F.format_string("rgb(%d, %d, %d)", pick("r", 256), pick("g", 256), pick("b", 256)).alias("background"),
    )
