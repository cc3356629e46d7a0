"""Versioned rows: latest per key, as-of lookups, snapshot diffs, history and upserts.

Every operator takes column names, so it runs on any table of the right shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW = "__row"


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (DISTINCT ON). The order should be total."""
    ranked = df.withColumn(ROW, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(ROW) == 1).drop(ROW)


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: list[str] | None = None) -> DataFrame:
    """The newest row of each key (J2, J3). Ties go to the smallest of ``tie``."""
    return first_per_key(df, keys, [F.desc(at), *map(F.asc, tie or [])])


def rows_of_latest(rows: DataFrame, versions: DataFrame, key: str, version: str, at: str) -> DataFrame:
    """Rows that belong to the newest version of their key: a semi join, no window over the rows.

    ``versions`` has one row per version; an aggregate that combines before the
    shuffle finds the newest.
    """
    newest = versions.groupBy(key).agg(F.max_by(version, at).alias(version)).select(version)
    return rows.join(newest, version, "left_semi")


def version_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Versions per key (A10)."""
    return df.groupBy(*keys).agg(F.count("*").alias("versions"))


def versions_of(df: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """All versions with their number, oldest first, and whether they are current."""
    w = Window.partitionBy(*keys).orderBy(at, *tie)
    return df.withColumn("version", F.row_number().over(w)).withColumn("is_current", F.lead(F.lit(1)).over(w).isNull())


def previous_version(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Each row with the columns of the latest strictly earlier row of its key, as ``prev_*``.

    Rows of one time have the same predecessor: the last row before that time.
    """
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct(F.col(at).alias("__at"), *columns)).over(w)
    return df.withColumn("__prev", last).select(*df.columns, *[F.col("__prev")[c].alias(f"prev_{c}") for c in columns])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, columns: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the columns of the latest right row of its key at or before it (before it, if ``strict``).

    One sort of both sides together; no row is compared with all others.
    """
    kept = [c for c in left.columns]
    a = left.select(*kept, F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__v"))
    b = right.select(*[F.col(c) if c in (*keys, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept], F.lit(1 if strict else 0).alias("__side"), F.struct(*columns).alias("__v"))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return both.where(F.col("__side") == (0 if strict else 1)).select(*kept, *[F.col("__v")[c].alias(f"asof_{c}") for c in columns])


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys that were added, removed or changed, with ``change`` (J8, U3). Comparison is null-safe."""
    a = old.select(*keys, F.struct(*compared).alias("__old"))
    b = new.select(*keys, F.struct(*compared).alias("__new"))
    both = a.join(b, keys, "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col("__old")[c].eqNullSafe(F.col("__new")[c])
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~same, "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change")


def diff_counts(diff: DataFrame, keys: list[str], index: str) -> DataFrame:
    """added, removed and changed per key, an index that several views share counted once (T5)."""
    return diff.groupBy(*keys).agg(*[F.count_distinct(F.when(F.col("change") == c, F.col(index))).alias(c) for c in ("added", "removed", "changed")])


def version_diffs(rows: DataFrame, versions: DataFrame, key: str, version: str, at: str, view: str, index: str, compared: list[str]) -> DataFrame:
    """Changes between each version and the one before it, per key (T-11, A.8).

    One row per version that changed anything: ``from_version``, ``to_version``
    and the counts. Keyed by version, so a second run gives the same rows.
    """
    pairs = previous_version(versions.select(key, version, at), [key], at, [version]).where(F.col(f"prev_{version}").isNotNull())
    pairs = pairs.select(key, F.col(version).alias("to_version"), F.col(f"prev_{version}").alias("from_version"))
    facts = rows.select(F.col(version).alias("__v"), view, index, F.struct(*compared).alias("__f"))
    new = pairs.join(facts, pairs.to_version == facts["__v"]).drop("__v").withColumnRenamed("__f", "__new")
    old = pairs.join(facts, pairs.from_version == facts["__v"]).drop("__v").withColumnRenamed("__f", "__old")
    keys = [key, "to_version", "from_version", view, index]
    both = new.join(old, keys, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return diff_counts(both.withColumn("change", change).where(F.col("change").isNotNull()), [key, "from_version", "to_version"], index)


def history_match(candidates: DataFrame, target: dict, version: str, kind: str, index: str, top: str) -> DataFrame:
    """The best candidate of each version: same kind first, nearest index, nearest top."""
    order = [(F.col(kind) != F.lit(target[kind])).cast("int"), F.abs(F.col(index) - target[index]), F.abs(F.col(top) - target[top]), F.col(index)]
    return first_per_key(candidates, [version], order)


def history(captures: DataFrame, matches: DataFrame, diffs: DataFrame, version: str, at: str, kind: str, wanted: str) -> DataFrame:
    """Versions newest first, with their match where it is of the wanted kind, and their diff."""
    shown = matches.where(F.col(kind) == wanted)
    return captures.join(shown, version, "left").join(diffs, version, "left").orderBy(F.desc(at), version)


# -- upserts: the state that a sequence of writes leaves --


def upsert_last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last write of each key (U4). Replaying the same writes changes nothing."""
    return first_per_key(df, keys, [F.desc(seq)])


def upsert_first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first write of each key."""
    return first_per_key(df, keys, [F.asc(seq)])


def upsert_merge(df: DataFrame, keys: list[str], seq: str, last: list[str] = (), first: list[str] = (), union: list[str] = (), last_where: dict[str, Column] | None = None) -> DataFrame:
    """Per-column merge rules (U5): last or first non-null value, sorted union of arrays, last value where a condition holds.

    Every rule is an aggregate, so it combines before the shuffle.
    """
    rules = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in last]
    rules += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first]
    rules += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in union]
    rules += [F.max_by(c, F.when(cond, F.col(seq))).alias(c) for c, cond in (last_where or {}).items()]
    return df.groupBy(*keys).agg(*rules)


def event_time_apply(df: DataFrame, keys: list[str], event_time: str, seq: str, done: Column | None = None) -> DataFrame:
    """The newest event of each key by event time, whatever order they came in (U7, T-13, W4). Equal times: the later arrival."""
    rows = df.where(done) if done is not None else df
    return first_per_key(rows, keys, [F.desc(event_time), F.desc(seq)])


def changed_only(new: DataFrame, known: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """New rows whose content hash is not the known one (U11, U18). ``known`` has the keys and ``hash``."""
    hashed = new.withColumn("hash", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))
    return hashed.join(known.select(*keys, "hash"), [*keys, "hash"], "left_anti")


def missing(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a result (T-12, J6)."""
    return requests.join(results.select(*keys), keys, "left_anti")
