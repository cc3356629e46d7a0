"""Running sums over ranges, and facet counts from bitmaps."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from quern.operators import bitmaps, facets, prefix, ranking


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"g{i}"]), rng.randrange(30), rng.choice([None, rng.randrange(9)])) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, g string, k int, c long").repartition(7)


@pytest.mark.parametrize("group", [None, ["g"]])
@pytest.mark.parametrize("ranges", [1, 6, 50])
def test_running_sums(lines, group, ranges):
    rows, df = lines
    got = {r["id"]: (r["n"], r["total"]) for r in prefix.running(df, [F.desc("k"), F.asc("id")], {"n": F.lit(1).cast("long"), "total": F.col("c")}, group, ranges).collect()}
    want = {}
    for g in {r[1] for r in rows} if group else {0}:
        mine = sorted((r for r in rows if not group or r[1] == g), key=lambda r: (-r[2], r[0]))
        want |= {r[0]: (i + 1, s) for i, (r, s) in enumerate(zip(mine, accumulate(r[3] or 0 for r in mine), strict=True))}
    assert got == want


def test_no_task_sees_the_table(lines):
    _, df = lines
    plan = prefix.numbered(df, [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("[__range" in x for x in windows) and "rangepartitioning" not in plan
    assert prefix.numbered(df.limit(0), [F.asc("id")]).count() == 0
    assert [r["pick"] for r in ranking.round_robin(df, "g", [F.asc("id")]).orderBy("pick").collect()] == list(range(1, 401))
    with pytest.raises(ValueError):
        ranking.quota_sample(df.sparkSession.range(10_001), "id", [F.asc("id")], 5)


def test_bitmaps_count_like_the_scan(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["x", "y", "z", None]), rng.randrange(4), rng.choice([None, [], ["p"], ["p", "q", "p"], ["q", None]])) for _ in range(500)]
    df = spark.createDataFrame(rows, "a string, b int, tags array<string>").repartition(3)
    fs = {"a": facets.Facet(F.col("a")), "b": facets.Facet(F.col("b")), "t": facets.Facet(F.array_distinct("tags"), is_array=True)}
    bits = bitmaps.build(df, fs, str(tmp_path / "b"), "s")
    told = lambda d: sorted(map(tuple, d.select("key", "value", "n").collect()))
    for wanted in ({}, {"a": ["x", "y"]}, {"a": ["x"], "b": ["1", "2"]}, {"a": ["z"], "b": ["0"], "t": ["q"]}, {"a": ["none"]}, {"a": ["none"], "t": ["p"]}):
        assert told(bitmaps.counts(bits, [*fs], facets.Filters(wanted))) == told(facets.facet_counts(df, fs, facets.Filters(wanted)))
    assert bitmaps.current(spark, str(tmp_path / "b"), "other") is None
    plan = bitmaps.counts(bits, [*fs], facets.Filters({"a": ["x"]}))._jdf.queryExecution().executedPlan().toString()
    assert "/rows" not in plan
    assert told(bitmaps.counts(bitmaps.build(df.limit(0), fs, str(tmp_path / "e")), [*fs], facets.Filters({"a": ["x"]}))) == []
