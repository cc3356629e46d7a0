"""Aggregates: ordered modes, conditional sums, ledgers, agreement, coverage and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mode_first_seen(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """The most frequent value of each key, the one seen first among ties (A18). Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col("first"))).alias("m")).select(*keys, f"m.{value}", "m.n")


def filtered_sums(df: DataFrame, keys: list[str], rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """name -> (condition, value): sums of a value, or counts, over rows that meet a condition."""
    aggs = [(F.count_if(c) if v is None else F.sum(F.when(c, v))).alias(k) for k, (c, v) in rules.items()]
    return df.groupBy(*keys).agg(*aggs)


def mean_if_enough(column: Column, least: int = 20) -> Column:
    """The average of what is not null, null below a minimum count."""
    return F.when(F.count(column) >= least, F.avg(column))


def mean_without_zero(column: Column) -> Column:
    return F.avg(F.nullif(column, F.lit(0)))


def ledger(requests: DataFrame, batch: str = "batch_id", status: str = "status", tokens_in: str = "input_tokens", tokens_out: str = "output_tokens", cost: str = "cost", model: str = "model") -> DataFrame:
    """Per status: requests, batches, tokens, cost and models."""
    return requests.groupBy(status).agg(
        F.count("*").alias("requests"),
        F.count_distinct(batch).alias("batches"),
        F.coalesce(F.sum(tokens_in), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(tokens_out), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(cost), F.lit(0)).alias("cost"),
        F.sort_array(F.collect_set(model)).alias("models"),
    )


def batch_totals(batches: DataFrame, requests: DataFrame, batch: str, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Batches with totals of their requests (J17); 0 where there is none."""
    totals = filtered_sums(requests, [batch], rules)
    joined = batches.join(totals, batch, "left")
    return joined.fillna(0, [*rules])


def agreement(gold: DataFrame, predicted: DataFrame, key: str, label: str, guess: str) -> tuple[DataFrame, DataFrame]:
    """Accuracy as one row, and (gold, predicted, n) of mismatches (A17). A missing answer is ``(no answer)``."""
    pairs = gold.select(key, F.col(label).alias("gold")).join(predicted.select(key, F.col(guess).alias("predicted")), key, "left")
    pairs = pairs.withColumn("predicted", F.coalesce("predicted", F.lit("(no answer)"))).withColumn("match", F.col("gold") == F.col("predicted"))
    score = pairs.agg(F.count("*").alias("total"), F.count_if("match").alias("agreed"), F.avg(F.col("match").cast("double")).alias("accuracy"))
    return score, pairs.where(~F.col("match")).groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def top_reasons(df: DataFrame, scope: list[str], reason: str, k: int = 12) -> DataFrame:
    """The k most frequent reasons per scope."""
    counts = df.where(F.col(reason).isNotNull()).groupBy(*scope, reason).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*scope).orderBy(F.desc("n"), F.asc(reason))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def breakdown(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts per row value, one column per listed value (A14). Listed values spare a pass over the data."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def progress(df: DataFrame, status: str, ms: str, size: str, parallel: int, open_: tuple[str, ...] = ("pending", "running")) -> DataFrame:
    """remaining, mean ms, expected ms and bytes to come."""
    remaining = F.count_if(F.col(status).isin(*open_))
    mean_ms, mean_size = mean_without_zero(F.col(ms)), mean_without_zero(F.col(size))
    return df.agg(remaining.alias("remaining"), mean_ms.alias("mean_ms"), (remaining * mean_ms / parallel).alias("eta_ms"), (remaining * mean_size).alias("bytes_to_come"))


def tally(df: DataFrame, column: str, is_array: bool = False) -> DataFrame:
    """Counts per value or array element."""
    values = df.select((F.explode(column) if is_array else F.col(column)).alias(column))
    return values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def median_by_index(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at index floor(n / 2) of the sorted non-null values."""
    w = Window.partitionBy(*keys).orderBy(value)
    sizes = df.where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return sizes.where(F.col("__i") == F.floor(F.col("__n") / 2)).select(*keys, F.col(value).alias("median"))


def next_position(items: DataFrame, board: str, position: str) -> DataFrame:
    """Where the next item of each board goes."""
    return items.groupBy(board).agg((F.coalesce(F.max(position), F.lit(-1)) + 1).alias("next_position"))


def interval_coverage(df: DataFrame, keys: list[str], start: str, end: str, total: str, too_tall: float | None = None) -> DataFrame:
    """Share of ``total`` that intervals cover, overlaps once; intervals over ``too_tall`` of it are skipped."""
    rows = df.where(F.col(end) > F.col(start))
    if too_tall is not None:
        rows = rows.where(F.col(end) - F.col(start) <= F.col(total) * too_tall)
    before = F.max(end).over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce("__before", F.col(start))))
    return rows.withColumn("__before", before).groupBy(*keys).agg(F.sum(gain).alias("covered"), F.max(total).alias("total")).withColumn("coverage", F.col("covered") / F.col("total"))


def best_cut(df: DataFrame, keys: list[str], way: str, priority: str, coverage: str, pieces: str, least: float = 0.6, most_pieces: int = 3) -> DataFrame:
    """The first way that covers enough with enough pieces, else the one that covers most."""
    good = (F.col(coverage) >= least) & (F.col(pieces) >= most_pieces)
    return df.groupBy(*keys).agg(F.coalesce(F.min_by(way, F.when(good, F.col(priority))), F.max_by(way, F.struct(coverage, pieces, -F.col(priority)))).alias(way))


def capture_status(ok: Column, wanted: Column) -> Column:
    """captured if all views are there, partial if some, failed if none."""
    return F.when(ok >= wanted, "captured").when(ok > 0, "partial").otherwise("failed")


def store_status(problems: Column, most: int = 3) -> Column:
    """status and reason of a store from its pages' problems."""
    return F.struct(F.when(F.size(problems) > 0, "partial").otherwise("done").alias("status"), F.when(F.size(problems) > 0, F.array_join(F.slice(problems, 1, most), " | ")).alias("reason"))


def candidate_fold(df: DataFrame, host: str, source: str, url: str, seq: str, first: list[str]) -> DataFrame:
    """Candidates by host: mentions are distinct URLs, sources a set, other facts the first that is set."""
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first]
    return df.groupBy(host).agg(F.count_distinct(url).alias("mentions"), F.sort_array(F.collect_set(source)).alias("sources"), *aggs)


def reason_groups(df: DataFrame, reason: str, host: str) -> DataFrame:
    """Hosts by family of reason: what follows a colon or a number is left out; larger groups first."""
    family = F.trim(F.regexp_replace(F.regexp_replace(F.col(reason), r":.*$", ""), r"\d+", "#"))
    return df.groupBy(family.alias("family")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(host)).alias("hosts")).orderBy(F.desc("n"), "family")
