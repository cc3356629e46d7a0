"""Walls: facets, near misses, pages, de-duplication and versions."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import functions as F

from quern.operators import bitmaps, dedup, facets, joins, paging, versions
from quern.plans.registry import query, table
from quern.sources import commits

WANTED = {"status": ["O", "F"], "segment": ["BUILDING", "MACHINERY"], "flag": ["R"]}
WALL_SQL = """
WITH flags AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1),
wall AS (
  SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, n_name AS nation, r_name AS region, flags
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN flags ON l_orderkey = o_orderkey),
ok AS (SELECT *, coalesce(status IN ('O', 'F'), false) AS ok_status, coalesce(segment IN ('BUILDING', 'MACHINERY'), false) AS ok_segment,
  coalesce(list_contains(flags, 'R'), false) AS ok_flag FROM wall)
"""


def wall(spark, sf_dir):
    """Orders with their facets: four scalars from joins and one array of line flags."""
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    rows = joins.star(
        table(spark, sf_dir, "orders"),
        (table(spark, sf_dir, "customer"), "o_custkey", "c_custkey"),
        (table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey"),
        (table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey"),
    )
    return rows.join(flags, "o_orderkey", "left").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "flags")




def wall_facets():
    return {k: facets.Facet(F.col(k)) for k in ("status", "priority", "segment", "nation", "region")} | {"flag": facets.Facet(F.col("flags"), is_array=True)}


def _facet_sql(filters: dict) -> str:
    ok = {k: f"ok_{k}" for k in filters}
    others = lambda k: " AND ".join([c for j, c in ok.items() if j != k] or ["true"])
    parts = [f"SELECT '{k}' AS key, {k} AS value, count(*) AS n FROM ok WHERE {others(k)} AND {k} IS NOT NULL GROUP BY 2" for k in ("status", "priority", "segment", "nation", "region")]
    parts.append(f"SELECT 'flag' AS key, value, count(*) AS n FROM (SELECT unnest(flags) AS value FROM ok WHERE {others('flag')}) GROUP BY 2")
    parts.append(f"SELECT '#total' AS key, '' AS value, count(*) AS n FROM ok WHERE {others('')} HAVING count(*) > 0")
    parts += [f"SELECT '#near' AS key, '{k}' AS value, count(*) AS n FROM ok WHERE {others(k)} AND NOT {ok[k]} HAVING count(*) > 0" for k in filters]
    return WALL_SQL + " UNION ALL ".join(parts)


@query(_facet_sql({}))
def facet_counts_all(spark, sf_dir):
    """Counts of every facet value with no filter set."""
    return facets.facet_counts(wall(spark, sf_dir), wall_facets(), facets.Filters())


@query(_facet_sql(WANTED))
def facet_counts_filtered(spark, sf_dir):
    """Counts under three filters, one of them on an array, with near misses."""
    return facets.facet_counts(wall(spark, sf_dir), wall_facets(), facets.Filters(WANTED))


def wall_bitmaps(spark, sf_dir):
    """The facets of all orders as bitmaps: made when a table has changed, read otherwise."""
    root = f"{commits.workspace(spark)}/wall-{crc32(sf_dir.encode()):08x}"
    source = " ".join(commits.signature(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "region", "lineitem"))
    found = bitmaps.current(spark, root, source)
    return found if found is not None else bitmaps.build(wall(spark, sf_dir), wall_facets(), root, source)


@query(_facet_sql({}))
def bitmap_counts_all(spark, sf_dir):
    """The rows of facet_counts_all, from stored bitmaps."""
    return bitmaps.counts(wall_bitmaps(spark, sf_dir), [*wall_facets()], facets.Filters())


@query(_facet_sql(WANTED))
def bitmap_counts_filtered(spark, sf_dir):
    """The rows of facet_counts_filtered, near misses included, from stored bitmaps."""
    return bitmaps.counts(wall_bitmaps(spark, sf_dir), [*wall_facets()], facets.Filters(WANTED))


@query(WALL_SQL + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS n FROM ok WHERE NOT ok_{k} AND {' AND '.join(f'ok_{j}' for j in WANTED if j != k)} HAVING count(*) > 0" for k in WANTED))
def near_miss_counts(spark, sf_dir):
    return facets.near_misses(facets.facet_counts(wall(spark, sf_dir), wall_facets(), facets.Filters(WANTED)))


@query("SELECT * FROM (SELECT 'nation' AS key, n_name AS value, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 2) QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 5 OR value IN ('CANADA', 'JAPAN')")
def top_facet_or_selected(spark, sf_dir):
    """The five most frequent nations and those selected."""
    return facets.top_or_selected(facets.facet_counts(wall(spark, sf_dir), {"nation": facets.Facet(F.col("nation"))}, facets.Filters()), "nation", 5, ["CANADA", "JAPAN"])


@query("SELECT o_orderkey, o_orderdate, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 60 OFFSET 120")
def wall_page(spark, sf_dir):
    """The third page of open orders, newest first."""
    rows = facets.where(table(spark, sf_dir, "orders"), {"status": facets.Facet(F.col("o_orderstatus"))}, facets.Filters.read({"status": "O, "}, ("status",)))
    page = paging.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], "60", "120")
    return page.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "o_totalprice", "c_name")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def keyset_page(spark, sf_dir):
    return paging.keyset(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 100, 50)


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n, (SELECT count(*) FROM supplier) AS total FROM supplier QUALIFY n BETWEEN 6 AND 10")
def numbered_page(spark, sf_dir):
    """A page with row numbers and the total."""
    rows = table(spark, sf_dir, "supplier")
    return paging.with_total(paging.numbered(rows, [F.desc("s_acctbal"), F.asc("s_suppkey")], 5, 5), rows).select("s_suppkey", "s_name", "n", "total")


@query("SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer) WHERE coalesce(c_mktsegment IN ('MACHINERY', 'BUILDING'), false)")
def nullsafe_filters(spark, sf_dir):
    """A null value fails a filter; it is never unknown."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return facets.where(rows, {"segment": facets.Facet(F.col("c_mktsegment"))}, facets.Filters({"segment": ["MACHINERY", "BUILDING"]}))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_type), 'ar')")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(facets.contains_text([F.col("p_name"), F.col("p_type")], " AR ")).select("p_partkey", "p_name")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_order_per_customer(spark, sf_dir):
    return versions.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


LINE_BLOCKS = """
SELECT l_orderkey, l_linenumber, p_brand AS host, l_returnflag AS view, CASE p_size % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'collection' WHEN 2 THEN 'product' ELSE 'cart' END AS page_type,
  CASE WHEN p_size % 3 = 0 THEN p_type || '-part' ELSE p_type END AS kind, p_name AS url, l_linenumber AS idx, l_orderkey * 10 + l_linenumber AS id
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def line_blocks(spark, sf_dir):
    """Line items seen as blocks of a page."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size") % 4
    return rows.select(
        F.col("p_brand").alias("host"),
        F.col("l_returnflag").alias("viewport"),
        F.when(size == 0, "home").when(size == 1, "collection").when(size == 2, "product").otherwise("cart").alias("page_type"),
        F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit("-part"))).otherwise(F.col("p_type")).alias("block_type"),
        F.lit(None).cast("string").alias("type_hint"),
        F.col("p_name").alias("url"),
        F.col("l_linenumber").alias("block_index"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


@query(
    f"SELECT host, view AS viewport, regexp_replace(kind, '-part$', '') AS section, id FROM ({LINE_BLOCKS}) QUALIFY row_number() OVER (PARTITION BY host, view, regexp_replace(kind, '-part$', '') "
    "ORDER BY CASE page_type WHEN 'home' THEN 1 WHEN 'collection' THEN 2 WHEN 'product' THEN 3 ELSE 99 END, CASE WHEN kind LIKE '%-part' THEN 1 ELSE 0 END, url, idx, id) = 1"
)
def section_dedup(spark, sf_dir):
    """One block per host, view and section."""
    return dedup.shown_per_section(line_blocks(spark, sf_dir)).select("host", "viewport", "section", "id")


@query("SELECT o_orderkey, o_custkey, max(o_orderdate) OVER w AS prev_o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)")
def previous_order(spark, sf_dir):
    """The latest strictly earlier order of the same customer."""
    return versions.previous_version(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", ["o_orderdate"]).select("o_orderkey", "o_custkey", "prev_o_orderdate")


@query("SELECT e.event_id, o.o_orderkey AS asof_o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_previous_order(spark, sf_dir):
    """Each event with its user's latest order at or before it."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.min("o_orderkey").alias("o_orderkey"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return versions.asof_join(events, orders.withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType)), ["user_id"], "ts", ["o_orderkey"]).select("event_id", "asof_o_orderkey")


@query(
    """
WITH a AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem WHERE l_shipdate < DATE '1995-06-17' GROUP BY 1, 2),
b AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem WHERE l_shipdate >= DATE '1995-06-17' GROUP BY 1, 2)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey,
  CASE WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
WHERE a.q IS NULL OR b.q IS NULL OR a.q <> b.q OR a.f <> b.f
"""
)
def snapshot_diff(spark, sf_dir):
    """Part and supplier pairs of two halves of time: added, removed or changed."""
    lines = table(spark, sf_dir, "lineitem")
    half = lambda c: lines.where(c).groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    cut = F.lit("1995-06-17").cast("date")
    return versions.snapshot_diff(half(F.col("l_shipdate") < cut), half(F.col("l_shipdate") >= cut), ["l_partkey", "l_suppkey"], ["q", "f"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END, abs(l_linenumber - 3), abs(l_quantity - 20), l_linenumber) = 1")
def history_best_match(spark, sf_dir):
    """The best matching line of each order: same flag, nearest number, nearest quantity."""
    lines = table(spark, sf_dir, "lineitem")
    found = versions.history_match(lines, {"l_returnflag": "R", "l_linenumber": 3, "l_quantity": 20}, "l_orderkey", "l_returnflag", "l_linenumber", "l_quantity")
    return found.select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_last_wins(spark, sf_dir):
    return versions.upsert_last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, arg_max(value, event_id) AS value, arg_min(event_type, event_id) AS first_type, list_sort(list(DISTINCT event_type)) AS types, arg_max(props, event_id) FILTER (WHERE event_type = 'purchase') AS props FROM events GROUP BY 1")
def upsert_merge_rules(spark, sf_dir):
    """Last value, first type, union of types, and the last properties of a purchase."""
    rows = table(spark, sf_dir, "events").withColumn("first_type", F.col("event_type")).withColumn("types", F.array("event_type"))
    return versions.upsert_merge(rows, ["user_id"], "event_id", last=["value"], first=["first_type"], union=["types"], last_where={"props": F.col("event_type") == "purchase"})


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def insert_or_nothing(spark, sf_dir):
    """The first write of a key wins."""
    return versions.upsert_first_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations WHERE role <> 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def conversation_latest_turn(spark, sf_dir):
    """The latest answer of each conversation."""
    rows = versions.event_time_apply(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "turn", F.col("role") != "user")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, lead(1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL AS is_current FROM orders")
def order_versions(spark, sf_dir):
    return versions.versions_of(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]).select("o_orderkey", "o_orderdate", "version", "is_current")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders GROUP BY o_custkey)")
def lines_of_latest_order(spark, sf_dir):
    """Lines of each customer's latest order, by semi join."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return versions.rows_of_latest(table(spark, sf_dir, "lineitem"), orders, "o_custkey", "l_orderkey", "at").select("l_orderkey", "l_linenumber")


@query(
    """
WITH u AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1),
v AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS prev FROM u),
n AS (SELECT v.*, l_linenumber, l_returnflag, l_partkey FROM v JOIN lineitem ON l_orderkey = o_orderkey WHERE prev IS NOT NULL),
p AS (SELECT v.*, l_linenumber, l_returnflag, l_partkey FROM v JOIN lineitem ON l_orderkey = prev WHERE prev IS NOT NULL),
d AS (SELECT coalesce(n.o_custkey, p.o_custkey) AS o_custkey, coalesce(n.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(n.prev, p.prev) AS prev, coalesce(n.l_linenumber, p.l_linenumber) AS idx,
  CASE WHEN p.l_partkey IS NULL THEN 'added' WHEN n.l_partkey IS NULL THEN 'removed' WHEN n.l_partkey <> p.l_partkey THEN 'changed' END AS change
  FROM n FULL OUTER JOIN p ON n.o_orderkey = p.o_orderkey AND n.l_linenumber = p.l_linenumber AND n.l_returnflag = p.l_returnflag)
SELECT o_custkey, prev AS from_version, o_orderkey AS to_version, count(DISTINCT idx) FILTER (WHERE change = 'added') AS added, count(DISTINCT idx) FILTER (WHERE change = 'removed') AS removed,
  count(DISTINCT idx) FILTER (WHERE change = 'changed') AS changed FROM d WHERE change IS NOT NULL GROUP BY 1, 2, 3
"""
)
def recapture_diffs(spark, sf_dir):
    """Each order against the customer's order before it, line by line."""
    single = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    twice = versions.version_count(single, ["o_custkey", "o_orderdate"]).where("versions = 1").drop("versions")
    orders = single.join(twice, ["o_custkey", "o_orderdate"], "left_semi").withColumnRenamed("o_orderkey", "version")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version"), "l_returnflag", "l_linenumber", "l_partkey")
    return versions.version_diffs(lines, orders, "o_custkey", "version", "o_orderdate", "l_returnflag", "l_linenumber", ["l_partkey"])


@query(
    """
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_linenumber) AS n FROM lineitem),
b AS (SELECT l_orderkey, n, l_linenumber FROM r WHERE l_returnflag = 'N'), s AS (SELECT l_orderkey, max(n) AS size FROM b GROUP BY 1)
SELECT r.l_orderkey, r.l_linenumber, b.l_linenumber AS counterpart FROM r LEFT JOIN s USING (l_orderkey) LEFT JOIN b ON b.l_orderkey = r.l_orderkey AND b.n = least(r.n, s.size) WHERE r.l_returnflag = 'A'
"""
)
def counterpart_pairing(spark, sf_dir):
    """The n-th accepted line with the n-th new one, the last one if there are fewer."""
    return joins.counterpart(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", "l_shipdate", "A", "N", "l_linenumber").select("l_orderkey", "l_linenumber", "counterpart")


@query(
    """
WITH wanted AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) - 1 AS ord FROM lineitem WHERE l_linenumber % 2 = 0),
n AS (SELECT l_orderkey, count(*) AS n FROM wanted GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, coalesce(w.ord, coalesce(n.n, 0) + l.l_linenumber) AS position FROM lineitem l LEFT JOIN wanted w USING (l_orderkey, l_linenumber) LEFT JOIN n ON n.l_orderkey = l.l_orderkey
"""
)
def reorder_items(spark, sf_dir):
    """Even lines first by quantity, the others after them."""
    from pyspark.sql.window import Window

    lines = table(spark, sf_dir, "lineitem")
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")) - 1
    wanted = lines.where("l_linenumber % 2 = 0").withColumn("ord", order)
    items = lines.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("position"))
    return joins.reorder(items, "l_orderkey", "l_linenumber", "position", wanted, "ord")
