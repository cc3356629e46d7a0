"""Mutation semantics over logs and tables: queues, boards, rewrites and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.sources import commits


def queue_state(events: DataFrame, key: str, seq: str, kind: str, reason: str, max_attempts: int = 3) -> DataFrame:
    """Status, attempts and last reason of each queued item after its events in order (U8, T-7).

    Events: ``enqueue``, ``claim``, ``release``, ``fail``, ``finish``, ``reset``
    (a crash: running goes back to pending) and ``requeue`` (starts anew). A
    failed item waits again while it has attempts left. Attempts are claims
    since the last requeue, and the last event that counts decides the status,
    so windows do it; no fold over rows in Python.
    """
    by_key = Window.partitionBy(key).orderBy(seq)
    everything = by_key.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__epoch", F.sum((F.col(kind) == "requeue").cast("int")).over(everything))
    epoch = Window.partitionBy(key, "__epoch").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    gained = F.when(F.col(kind) == "claim", 1).when(F.col(kind) == "release", -1).otherwise(0)
    rows = rows.withColumn("attempts", F.sum(gained).over(epoch))
    status = (
        F.when(F.col(kind).isin("enqueue", "requeue", "release", "reset"), "pending")
        .when(F.col(kind) == "claim", "running")
        .when(F.col(kind) == "finish", "done")
        .when(F.col(kind) == "fail", F.when(F.col("attempts") < max_attempts, "pending").otherwise("failed"))
    )
    rows = rows.withColumn("status", status)
    return rows.groupBy(key).agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col(seq))).alias("status"),
        F.max_by("attempts", seq).alias("attempts"),
        F.max_by(reason, F.when(F.col(kind) == "fail", F.col(seq))).alias("reason"),
    )


def claim_next(queue: DataFrame, order: list[Column], now: Column, n: int = 1) -> DataFrame:
    """Pending rows whose time has come, the first in order."""
    return queue.where((F.col("status") == "pending") & (F.col("next_try_at").isNull() | (F.col("next_try_at") <= now))).orderBy(*order).limit(n)


def board_items(log: DataFrame, board: str = "board_id", item: str = "block_id", seq: str = "seq", kind: str = "kind", note: str = "note", most: int = 2000) -> DataFrame:
    """Items of boards after a log of add, note and remove (U14): the last note wins, cut to ``most`` characters."""
    state = log.groupBy(board, item).agg(
        F.max_by(kind, F.when(F.col(kind).isin("add", "remove"), F.col(seq))).alias("__last"),
        F.max(F.when(F.col(kind) == "remove", F.col(seq))).alias("__gone"),
        F.min(F.when(F.col(kind) == "add", F.col(seq))).alias("added"),
        F.max_by(F.struct(note, seq), F.when(F.col(kind) == "note", F.col(seq))).alias("__note"),
        F.max(seq).alias("updated"),
    )
    live = state.where(F.col("__last") == "add")
    kept = F.when(F.col("__gone").isNull() | (F.col("__note")[seq] > F.col("__gone")), F.substring(F.col("__note")[note], 1, most))
    return live.select(board, item, "added", "updated", kept.alias(note))


def own_and_borrowed(own: DataFrame, by_token: DataFrame, key: str, created: str) -> DataFrame:
    """Boards of an account and boards by token that the account does not own, newest first (U16)."""
    return own.unionByName(by_token.join(own.select(key), key, "left_anti"), allowMissingColumns=True).orderBy(F.desc(created), key)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def audit_contains(df: DataFrame, needle: str) -> DataFrame:
    """(column, rows) that hold a text, for every string column: one scan."""
    cols = string_columns(df)
    counts = df.agg(*[F.count_if(F.coalesce(F.col(c).contains(needle), F.lit(False))).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("rows")) for c in cols])).alias("x")).select("x.column", "x.rows")


def rewrite_prefix(df: DataFrame, old: str, new: str) -> DataFrame:
    """Every string column with one text replaced by another."""
    cols = set(string_columns(df))
    return df.select(*[F.replace(F.col(c), F.lit(old), F.lit(new)).alias(c) if c in cols else F.col(c) for c in df.columns])


def verify_rewritten(df: DataFrame, old: str) -> DataFrame:
    """The frame itself; raises if any string column still holds ``old``."""
    left = audit_contains(df, old).agg(F.sum("rows")).first()[0]
    if left:
        raise ValueError(f"{left} values still hold {old!r}")
    return df


def duplicates(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Keys that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is set and not allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def cascade(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children left after their parents are deleted."""
    return child.join(gone.select(key), key, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    return union_all(frames).distinct()


def refresh_view(df: DataFrame, path: str, keep: int = 2) -> DataFrame:
    """Recompute a stored table (U9): readers by :func:`commits.read` see the old rows or the new ones, at every moment.

    The new rows are a version of their own and a pointer written last makes
    them the current one; versions beyond ``keep`` are deleted.
    """
    commits.commit(df.sparkSession, path.rstrip("/"), lambda folder: df.write.parquet(folder), keep=keep)
    return commits.read(df.sparkSession, path.rstrip("/"))
