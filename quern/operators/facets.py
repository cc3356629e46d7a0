"""Multi-facet counting in one pass, near misses, and the filters they rest on.

A row counts for a value of facet k if it passes every filter but k's own. One
scan works out which filters a row fails: with none failed it counts for all
its values, with exactly one failed it counts for the values of that facet
alone. So there is no scan per facet and no join; a single aggregate follows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed


@dataclass(frozen=True)
class Facet:
    """A facet's value per row; an array column counts each element."""

    value: Column
    is_array: bool = False

    def passes(self, wanted: list[str] | None) -> Column:
        """Null fails, it is never unknown (F2); no wanted values: all pass."""
        if not wanted:
            return F.lit(True)
        met = F.arrays_overlap(self.value, F.array(*map(F.lit, wanted))) if self.is_array else self.value.isin(list(wanted))
        return F.coalesce(met, F.lit(False))


@dataclass(frozen=True)
class Filters:
    """Wanted values by facet: any of them within a facet, all facets together (F1)."""

    wanted: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def read(params: dict[str, str], keys: tuple[str, ...] = fixed.FILTER_KEYS) -> Filters:
        """From request parameters: comma-separated, trimmed, empty values dropped."""
        found = {k: [v.strip() for v in params[k].split(",") if v.strip()] for k in keys if params.get(k)}
        return Filters({k: v for k, v in found.items() if v})

    def allowed(self, keys: tuple[str, ...] = fixed.FREE_FILTER_KEYS) -> Filters:
        """Only the filters a viewer is entitled to."""
        return Filters({k: v for k, v in self.wanted.items() if k in keys})

    def without(self, key: str) -> Filters:
        return Filters({k: v for k, v in self.wanted.items() if k != key})


def where(df: DataFrame, facets: dict[str, Facet], filters: Filters, skip: tuple[str, ...] = ()) -> DataFrame:
    """Rows that pass all filters that are set, but for those left out."""
    tests = [facets[k].passes(v) for k, v in filters.wanted.items() if k in facets and k not in skip]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def facet_counts(df: DataFrame, facets: dict[str, Facet], filters: Filters, extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, value, n): counts per facet value, ``#total`` and, for filters that are set, ``#near``.

    ``extra`` are conditions without a facet, such as a search (A3); they take
    part in near misses.
    """
    set_keys = [k for k in facets if filters.wanted.get(k)]
    ok = {k: facets[k].passes(filters.wanted[k]) for k in set_keys} | {k: F.coalesce(c, F.lit(False)) for k, c in (extra or {}).items()}
    fails = sum(((~c).cast("int") for c in ok.values()), F.lit(0))
    first = F.coalesce(*[F.when(~c, F.lit(k)) for k, c in ok.items()]) if ok else F.lit(None).cast("string")
    seen = df.select(fails.alias("__fails"), first.alias("__only"), *[f.value.alias(f"__v_{k}") for k, f in facets.items()]).where("__fails <= 1")
    # one array of structs a row; plain arrays and no lambdas, so that it stays in generated code
    single, several = [], []
    for k, f in facets.items():
        value = F.when((F.col("__fails") == 0) | (F.col("__only") == k), F.col(f"__v_{k}"))
        if f.is_array:
            value = F.array_compact(F.coalesce(value, F.array())).cast("array<string>")
            several.append(F.arrays_zip(F.array_repeat(F.lit(k), F.size(value)).alias("key"), value.alias("value")))
        else:
            single.append(F.when(value.isNotNull(), F.struct(F.lit(k).alias("key"), value.cast("string").alias("value"))))
    mark = F.when(F.col("__fails") == 0, F.struct(F.lit("#total").alias("key"), F.lit("").alias("value"))).otherwise(F.struct(F.lit("#near").alias("key"), F.col("__only").alias("value")))
    told = seen.select(F.explode(F.concat(F.array(*single, mark), *several)).alias("e")).where("e IS NOT NULL").select("e.key", "e.value")
    return told.groupBy("key", "value").agg(F.count("*").alias("n"))


def ordered(counts: DataFrame) -> DataFrame:
    """Facet order: key, then count descending, then value (A5)."""
    return counts.orderBy("key", F.desc("n"), "value")


def near_misses(counts: DataFrame) -> DataFrame:
    """(key, n) of filters that alone keep rows out (A2)."""
    return counts.where("key = '#near'").select(F.col("value").alias("key"), "n")


def top_or_selected(counts: DataFrame, key: str, k: int, selected: list[str]) -> DataFrame:
    """The k most frequent values of a facet and those selected."""
    mine = counts.where(F.col("key") == key)
    top = mine.orderBy(F.desc("n"), "value").limit(k)
    return top.unionByName(mine.where(F.col("value").isin(selected))).distinct()


def rolled_up(counts: DataFrame, key: str, bucket: Column) -> DataFrame:
    """Counts of one facet folded into buckets of its values; what has none is dropped (A4)."""
    mine = counts.where(F.col("key") == key).withColumn("value", bucket).where(F.col("value").isNotNull())
    return counts.where(F.col("key") != key).unionByName(mine.groupBy("key", "value").agg(F.sum("n").alias("n")))


def contains_text(columns: list[Column], q: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    q = q.strip().lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(q), F.lit(False)) for c in columns]) if q else F.lit(True)


def contains_all_words(columns: list[Column], q: str) -> Column:
    """Every word of the query is a word of the columns."""
    tokens = F.split(F.lower(F.concat_ws(" ", *columns)), r"[^a-z0-9]+")
    return F.lit(True) if not q.split() else reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in q.lower().split()])


def listed(df: DataFrame, wanted: dict[str, object], columns: list[Column], q: str | None = None) -> DataFrame:
    """Rows under optional filters, left out where they are None, and an optional text."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df.where(contains_text(columns, q)) if q else df


def yes_no_of(condition: Column) -> Column:
    """A condition as the facet values yes and no."""
    return F.when(condition, F.lit("yes")).otherwise(F.lit("no"))


def yes_no(count: Column) -> Facet:
    """A count as a facet of yes and no."""
    return Facet(yes_no_of(F.coalesce(count, F.lit(0)) > 0))


def named_types(counts: DataFrame, key: str) -> DataFrame:
    """Values of one facet that name a kind, parts left out, most frequent first."""
    return counts.where((F.col("key") == key) & ~F.col("value").endswith("-part")).orderBy(F.desc("n"), "value")
