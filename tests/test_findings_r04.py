"""Inputs that the findings of round 4 are about: repeated addresses, hits beside midnight, many rows a key."""

import datetime
import json
import os
import re

import duckdb
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import joins, search, textindex
from quern.plans.catalog import QUERIES, SQL
from quern.sources import manifests


def both(spark, sf_dir: str, name: str, **tables) -> tuple[list, list]:
    """Sorted rows of a query and of its SQL over tables that are written first."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{sf_dir}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    found = con.execute(SQL[name])
    columns = [x[0] for x in found.description]
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf_dir).collect()), key=str), sorted(found.fetchall(), key=str)


def shuffled(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


def test_hits_beside_midnight(spark, tmp_path):
    """The day of a hit is that of its nearest whole second, halves to the even one."""
    at = lambda day, h, m, s, us: datetime.datetime(2024, 1, day, h, m, s, us)
    times = [at(1, 23, 59, 58, 0), at(1, 23, 59, 59, 499_999), at(1, 23, 59, 59, 500_000), at(1, 23, 59, 59, 700_000), at(2, 0, 0, 0, 500_000), at(2, 5, 0, 0, 1), None, None, None, datetime.datetime(1969, 12, 31, 23, 0)]
    events = spark.createDataFrame([(i, t, 7) for i, t in enumerate(times)], "event_id long, ts timestamp_ntz, user_id long")
    got, want = both(spark, str(tmp_path), "rate_limit_verdicts", events=events)
    assert got == want
    assert [r[1] for r in sorted(got)][:6] == [1, 2, 1, 2, 3, 4]


def test_pages_that_share_their_url(spark, tmp_path):
    """Each page of an import counts, also those with one url or none."""
    pages = spark.createDataFrame([(1, "https://a.example/x", ""), (2, "https://a.example/x", ""), (3, None, ""), (5, "https://a.example/x", ""), (6, 'https://a.example/"', ""), (None, "https://a.example/x", "")], "page_id long, url string, html string")
    got, want = both(spark, str(tmp_path), "quarantined_imports", pages=pages)
    assert got == want
    assert len(got) == 6


def test_a_key_of_many_rows_is_not_paired(spark):
    """Of the rows with one key the first goes into the join, alone."""
    rows = spark.range(400).select(F.col("id").alias("row"), (F.col("id") * 10).alias("number"), F.lit(1).alias("nation"))
    other = spark.range(300).select((F.col("id") + 5).alias("key"), F.when(F.col("id") % 2 == 0, 1).alias("area"), F.lit("x").alias("more"))
    found = joins.first_alternative(rows, "row", other, [("number", "key"), ("nation", "area")], "key")
    assert found.columns == ["row", "key", "area", "more"]
    assert {r["row"]: r["key"] for r in found.collect()} == {i: i * 10 if 5 <= i * 10 < 305 else 5 for i in range(400)}
    plan = found._jdf.queryExecution()
    plan.executedPlan().execute().count()
    made = re.findall(r"Join", plan.executedPlan().toString())
    assert made and most_rows(plan.executedPlan()) <= 800


def most_rows(plan) -> int:
    """The most rows that a node of an executed plan gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    below = [plan.children().apply(i) for i in range(plan.children().size())] + ([plan.plan()] if "QueryStage" in plan.nodeName() else [])
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def test_the_index_is_built_without_a_shuffle(spark, tmp_path):
    """Texts become index rows where they are read: the build writes no shuffle files, whatever the batches."""
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(i % 60)), None if i % 3 else f"w{i % 5}") for i in range(500)]
    rows += [(1000, "w1 w2 " * 5000, "w3"), (None, "w1", "w1"), (1001, None, None)]
    docs = spark.createDataFrame(rows, "id long, body string, title string").repartition(3).localCheckpoint()
    before = shuffled(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        index = textindex.build(docs, "id", {"A": "title", "C": "body"}, str(tmp_path / "index"), block_docs=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shuffled(spark) - before < 2000  # the count of the documents alone
    groups = [search.Group(("w1", "w7"), 2), search.Group(("w2 w1", "missing")), search.Group(("w3",))]
    want = search.matched_groups(docs.where("id is not null"), "id", {"A": "title", "C": "body"}, groups)
    got = sorted(map(tuple, textindex.matched(index, groups).collect()))
    assert got == sorted(map(tuple, want.select("id", "group", "weight", "field", "tf").collect())) and len(got) > 300
    assert sorted(map(tuple, textindex.top(index, groups, 20).collect())) == sorted(map(tuple, search.text_candidates(want, "id", 20).collect()))


def test_blocks_are_shuffled_once(spark, sf_dir):
    """Lines go by their order and blocks by their capture, and what is known of a capture is made without them."""
    size = os.path.getsize(f"{sf_dir}/lineitem.parquet") + os.path.getsize(f"{sf_dir}/orders.parquet")
    before = shuffled(spark)
    QUERIES["api_blocks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 4 * size


def test_blocks_that_come_twice_count_once(spark):
    """One id, one block: of documents that are read twice, and within a document; the joins give each its own facts."""
    blocks = [{"viewport": v, "index": i, "text": f"t{i}"} for v, i in (("desktop", 1), ("desktop", 1), (None, 1), ("mobile", 2))]
    made = [{"site": {"host": f"h{n % 2}", "platform": f"p{n % 2}"}, "page": {"url": f"u{n % 3}", "title": f"t{n}", "capturedAt": f"2024-01-01T00:00:0{n}Z"}, "blocks": blocks} for n in range(6)]
    docs = spark.createDataFrame([(json.dumps(d), f"f{k}") for d in made for k in range(2)], "d string, folder string")
    docs = docs.select(F.from_json("d", schemas.struct(schemas.MANIFEST)).alias("d"), "folder").select("d.*", "folder")
    rows = manifests.block_rows(docs).collect()
    assert len(rows) == len({r["id"] for r in rows}) == 18
    found = manifests.api_items(manifests.block_rows(docs), manifests.capture_rows(docs), manifests.page_rows(docs), manifests.site_rows(docs)).collect()
    assert sorted((r["url"], r["platform"], r["page_title"]) for r in found) == sorted((f"u{n % 3}", f"p{n % 2}", f"t{n}") for n in range(6) for _ in range(3))


def test_a_large_group_is_paired_by_chunks(spark):
    """All pairs of a nation, though no task gets the whole of it."""
    rows = spark.range(300).select(F.floor(F.col("id") % 7 / 6).alias("nation"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.col("id") % 50)).alias("name"), F.col("id").alias("key"))
    found = joins.other_hosts(rows, ["nation"], "name", "key", chunk=20)
    assert found.columns == ["nation", "host_a", "a", "host_b", "b"]
    every = [tuple(r) for r in rows.collect()]
    want = sorted((n, x, a, y, b) for n, x, a in every for m, y, b in every if n == m and x and y and x != y)
    assert sorted(map(tuple, found.collect())) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = joins.other_hosts(rows, ["nation"], "name", "key", chunk=20).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread > 2
