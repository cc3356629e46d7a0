"""Recursive descent of a tree of boxes (W24): cut into pieces of a size, by Spark's recursive common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The part of a box that its children have to fill, and the most steps down.
FILLED, HOPS = 0.6, 14


def steps_down(boxes: DataFrame, box: str = "id", parent: str = "parent", height: str = "height", seq: str = "seq") -> DataFrame:
    """(id, child, split): where a box leads. Two children or more that fill it split it; a wrapper with one leads to that one."""
    own = boxes.select(F.col(box).alias("id"), F.col(height).alias("h"))
    kids = boxes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("id"), F.col(box).alias("child"), F.col(height).alias("ch"), F.col(seq).alias("seq"))
    sums = kids.groupBy("id").agg(F.count("*").alias("n"), F.sum("ch").alias("sum"))
    met = kids.join(sums, "id").join(own, "id")
    several = met.where((F.col("n") > 1) & (F.col("sum") >= F.col("h") * FILLED))
    single = met.where((F.col("n") == 1) & (F.col("ch") >= F.col("h") * FILLED))
    return several.select("id", "child", F.lit(1).alias("split")).unionByName(single.select("id", "child", F.lit(0).alias("split")))


def refine(boxes: DataFrame, most_height: float, budget: int, box: str = "id", parent: str = "parent", height: str = "height", seq: str = "seq", hops: int = HOPS) -> DataFrame:
    """(root, id, splits, hops) of the pieces that boxes without a parent are cut into.

    A box is a piece when it is low enough (but not before the first cut), when
    ``budget`` splits or ``hops`` steps are used up, or when it leads nowhere.
    The bounds end the descent on a cycle as well. The descent makes as many rows
    as boxes it passes; the session's ``spark.sql.cteRecursionRowLimit`` has to
    allow for them.
    """
    spark = boxes.sparkSession
    edges = steps_down(boxes, box, parent, height, seq)
    walk = spark.sql(
        """
        WITH RECURSIVE walk(root, id, height, splits, hops, first) AS (
          SELECT id, id, height, 0, 0, true FROM {boxes} WHERE parent IS NULL
          UNION ALL
          SELECT w.root, e.child, e.height, w.splits + e.split, w.hops + 1, w.first AND e.split = 0
          FROM walk w JOIN {edges} e ON e.id = w.id
          WHERE (w.height > {most_height} OR w.first) AND w.splits < {budget} AND w.hops < {most_hops})
        SELECT * FROM walk
        """,
        boxes=boxes.select(F.col(box).alias("id"), F.col(parent).alias("parent"), F.col(height).cast("double").alias("height")),
        edges=edges.join(boxes.select(F.col(box).alias("child"), F.col(height).cast("double").alias("height")), "child"),
        most_height=float(most_height),
        budget=budget,
        most_hops=hops,
    )
    done = ((F.col("height") <= most_height) & ~F.col("first")) | (F.col("splits") >= budget) | (F.col("hops") >= hops)
    leads = edges.select("id").distinct().withColumn("leads", F.lit(True))
    return walk.join(leads, "id", "left").where(done | F.col("leads").isNull()).select("root", "id", "splits", "hops")
