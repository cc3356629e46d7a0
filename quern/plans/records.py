"""Boards, captures, queues and orders: joins, roll-ups, sorts and state rules over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import aggregates, dedup, facets, joins, layout, mutations, paging, profiles, ranking, state, versions
from quern.plans.registry import query, table
from quern.sources import files


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS known FROM customer")
def known_flags(spark, sf_dir):
    """Whether each customer has an order."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.known(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def missing_results(spark, sf_dir):
    """Orders without a returned line, as requests without a result."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return versions.missing(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query(
    "WITH k AS (SELECT s_suppkey, 0 AS p, c_custkey FROM supplier JOIN customer ON c_custkey = s_suppkey * 20 UNION ALL SELECT s_suppkey, 1, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey) "
    "SELECT s_suppkey, c_custkey FROM k QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY p, c_custkey) = 1"
)
def first_alternative(spark, sf_dir):
    """The customer that a supplier's number leads to, else the first of its nation."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 20).alias("number"), F.col("s_nationkey").alias("nation"))
    found = joins.first_alternative(rows, "s_suppkey", table(spark, sf_dir, "customer"), [("number", "c_custkey"), ("nation", "c_nationkey")], "c_custkey")
    return found.select("s_suppkey", "c_custkey")


@query("SELECT doc_id, lang, i - 1 AS rank FROM documents JOIN (SELECT unnest([40, 7, 99999999, 3, 120]) AS doc_id, generate_subscripts([40, 7, 99999999, 3, 120], 1) AS i) USING (doc_id)")
def in_list_order(spark, sf_dir):
    """Documents by the place of their id in a list; unknown ids drop out."""
    ids = files.zipped(spark, doc_id=[40, 7, 99999999, 3, 120]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").alias("rank"))
    return paging.in_list_order(table(spark, sf_dir, "documents").select("doc_id", "lang"), ids, "doc_id", "rank")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 99 END, o_orderkey LIMIT 40")
def custom_order(spark, sf_dir):
    """Orders by a fixed order of priorities, those not listed last."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return paging.in_fixed_order(rows, "o_orderpriority", ("5-LOW", "1-URGENT", "3-MEDIUM"), F.asc("o_orderkey")).limit(40)


@query("SELECT event_id, c_name, ts, event_id % 5 AS position FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def board_items_join(spark, sf_dir):
    """Items with the rows they stand for, by position and age."""
    items = table(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("position", F.col("event_id") % 5)
    return joins.items_in_order(items, table(spark, sf_dir, "customer"), "user_id", "c_custkey", "position", "ts").select("event_id", "c_name", "ts", "position")


@query(
    "SELECT o_orderkey, coalesce(t.lines, 0) AS lines, coalesce(t.returned, 0) AS returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 10) AS lines, coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'R'), 0) AS returned FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey"
)
def batch_totals(spark, sf_dir):
    """Orders with totals of their lines, 0 where there is none."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rules = {"lines": (F.col("l_quantity") > 10, None), "returned": (F.col("l_returnflag") == "R", F.col("l_linenumber"))}
    return aggregates.batch_totals(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", rules)


HISTORY_SQL = """
WITH m AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END, abs(l_linenumber - 3), abs(l_quantity - 20), l_linenumber) = 1),
d AS (SELECT l_orderkey, count(*) AS changed FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_orderkey, o_orderdate, m.l_linenumber, d.changed FROM orders LEFT JOIN m ON m.l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN d ON d.l_orderkey = o_orderkey
"""


@query(HISTORY_SQL)
def version_history(spark, sf_dir):
    """Versions with their match, where it is of the wanted kind, and their changes."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    best = versions.history_match(lines, {"l_returnflag": "R", "l_linenumber": 3, "l_quantity": 20}, "o_orderkey", "l_returnflag", "l_linenumber", "l_quantity")
    changes = lines.where("l_quantity > 25").groupBy("o_orderkey").agg(F.count("*").alias("changed"))
    captures = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return versions.history(captures, best.select("o_orderkey", "l_linenumber", "l_returnflag"), changes, "o_orderkey", "o_orderdate", "l_returnflag", "R").select("o_orderkey", "o_orderdate", "l_linenumber", "changed")


@query("SELECT a.s_nationkey, a.s_name AS host_a, a.s_suppkey AS a, b.s_name AS host_b, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_name <> b.s_name")
def other_hosts(spark, sf_dir):
    """Suppliers of one nation in pairs, never with themselves."""
    return joins.other_hosts(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_name", "s_suppkey")


@query(
    "SELECT count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS remaining, round(avg(nullif(o_custkey % 7, 0)), 6) AS mean_ms, round(count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) * avg(nullif(o_custkey % 7, 0)) / 3, 4) AS eta_ms, "
    "round(count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) * avg(nullif(o_custkey % 11, 0)), 4) AS bytes_to_come FROM orders"
)
def progress_projection(spark, sf_dir):
    """What is left, the mean time of what was done, and what is to come; zeros don't count as times."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") % 7).alias("ms"), (F.col("o_custkey") % 11).alias("size"))
    found = aggregates.progress(rows, "o_orderstatus", "ms", "size", 3, ("O", "P"))
    return found.select("remaining", F.round("mean_ms", 6).alias("mean_ms"), F.round("eta_ms", 4).alias("eta_ms"), F.round("bytes_to_come", 4).alias("bytes_to_come"))


@query(
    "WITH m AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2), b AS (SELECT user_id, event_type FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1) "
    "SELECT e.user_id, array_to_string(list_sort(list(DISTINCT 'app' || (event_id % 3))), ',') AS apps, any_value(b.event_type) AS event_type FROM events e LEFT JOIN b USING (user_id) GROUP BY 1"
)
def store_from_blocks(spark, sf_dir):
    """A store pieced together from its blocks: the mode of a fact and the union of its apps."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.array(F.concat(F.lit("app"), (F.col("event_id") % 3).cast("string"))).alias("apps"))
    return profiles.store_from_blocks(rows, "user_id", "event_id", ["event_type"], "apps").withColumn("apps", F.array_join("apps", ","))


@query(
    "SELECT user_id, arg_min(event_type, event_id) AS event_type, max(ts) AS captured_at, count(*) AS blocks, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE event_id % 2 = 0), '') AS desktop, "
    "coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE event_id % 2 = 1), '') AS mobile FROM events GROUP BY 1"
)
def pages_from_blocks(spark, sf_dir):
    """A page per group: first fact, latest date, counts and ordered ids by view."""
    view = F.when(F.col("event_id") % 2 == 0, "desktop").otherwise("mobile")
    rows = table(spark, sf_dir, "events").withColumn("view", view).withColumn("id", F.col("event_id"))
    found = profiles.pages_from_blocks(rows, ["user_id"], "event_id", "ts", "view", ["event_type"])
    return found.withColumn("desktop", F.array_join(F.col("desktop").cast("array<string>"), ",")).withColumn("mobile", F.array_join(F.col("mobile").cast("array<string>"), ","))


@query("SELECT conv_id, max(turn) + 1 AS next_position FROM conversations GROUP BY 1")
def next_position(spark, sf_dir):
    return aggregates.next_position(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query(
    "WITH v AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS ok, list_sort(list(l_linenumber::VARCHAR || ' late') FILTER (WHERE l_quantity > 45)) AS p FROM lineitem GROUP BY 1) "
    "SELECT l_orderkey, CASE WHEN ok >= 2 THEN 'captured' WHEN ok > 0 THEN 'partial' ELSE 'failed' END AS capture, CASE WHEN len(p) > 0 THEN 'partial' ELSE 'done' END AS store, CASE WHEN len(p) > 0 THEN array_to_string(p[1:3], ' | ') END AS reason FROM v"
)
def status_rollup(spark, sf_dir):
    """Status of a capture by its views, and of a store by its problems."""
    problem = F.when(F.col("l_quantity") > 45, F.concat(F.col("l_linenumber").cast("string"), F.lit(" late")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("ok"), F.array_sort(F.collect_list(problem)).alias("p"))
    return rows.select("l_orderkey", aggregates.capture_status(F.col("ok"), F.lit(2)).alias("capture"), aggregates.store_status(F.col("p")).alias("s")).select("l_orderkey", "capture", F.col("s.status").alias("store"), "s.reason")


@query(
    "WITH n AS (SELECT o_custkey AS page_id, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS capture_id, max(o_orderdate) AS captured_at FROM orders GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS blocks FROM lineitem GROUP BY 1) "
    "SELECT c_nationkey AS host, c_mktsegment AS page_type, c_name AS url, captured_at, coalesce(blocks, 0) AS blocks FROM customer JOIN n ON page_id = c_custkey LEFT JOIN b ON l_orderkey = capture_id"
)
def latest_pages(spark, sf_dir):
    """Pages at their latest capture with block counts, per store."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_nationkey").alias("host"), F.col("c_mktsegment").alias("page_type"), F.col("c_name").alias("url"))
    orders = table(spark, sf_dir, "orders")
    newest = versions.latest_per_key(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])
    captures = newest.select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("capture_id"), F.col("o_orderdate").alias("captured_at"))
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("capture_id"))
    found = profiles.latest_pages(pages, captures, blocks)
    return found.select("host", F.explode("pages").alias("p")).select("host", "p.page_type", "p.url", "p.captured_at", "p.blocks")


@query(
    "WITH r AS (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'http-' || (400 + p_size) ELSE 'wall: ' || p_type END AS reason FROM part), f AS (SELECT p_brand, trim(regexp_replace(regexp_replace(reason, ':.*$', ''), '[0-9]+', '#', 'g')) AS family FROM r) "
    "SELECT family, count(*) AS n, array_to_string(list_sort(list(p_brand)), ',') AS hosts FROM f GROUP BY 1"
)
def reason_families(spark, sf_dir):
    """Brands by family of reason; numbers and what follows a colon are left out."""
    reason = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("http-"), (400 + F.col("p_size")).cast("string"))).otherwise(F.concat(F.lit("wall: "), F.col("p_type")))
    return aggregates.reason_groups(table(spark, sf_dir, "part").withColumn("reason", reason), "reason", "p_brand").withColumn("hosts", F.array_join("hosts", ","))


@query(
    "WITH w AS (SELECT l_orderkey, l_linenumber, l_tax * 10 AS coverage, CAST(l_quantity AS INTEGER) % 5 AS pieces FROM lineitem), g AS (SELECT *, coverage >= 0.6 AND pieces >= 3 AS good FROM w) "
    "SELECT l_orderkey, coalesce(arg_min(l_linenumber, l_linenumber) FILTER (WHERE good), arg_max(l_linenumber, (coverage, pieces, -l_linenumber))) AS way FROM g GROUP BY 1"
)
def best_cut(spark, sf_dir):
    """The first way that covers enough with enough pieces, else the one that covers most."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("way"), F.col("l_linenumber").alias("priority"), (F.col("l_tax") * 10).alias("coverage"), (F.col("l_quantity").cast("int") % 5).alias("pieces"))
    return aggregates.best_cut(rows, ["l_orderkey"], "way", "priority", "coverage", "pieces")


PART_PAGES = (
    "SELECT p_partkey AS seq, p_brand || '-' || (p_partkey % 40) AS host, CASE p_size % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'collection' ELSE 'product' END AS page_type, p_size % 6 AS blocks, p_type AS industry, p_brand AS platform, p_name AS theme, (p_size % 3)::VARCHAR AS country, nullif(p_partkey % 9, 0) AS rank FROM part"
)


def part_pages(spark, sf_dir):
    """Parts seen as pages of stores."""
    size, key = F.col("p_size"), F.col("p_partkey")
    kind = F.when(size % 4 == 0, "home").when(size % 4 == 1, "collection").otherwise("product")
    return table(spark, sf_dir, "part").select(
        key.alias("seq"), F.concat("p_brand", F.lit("-"), (key % 40).cast("string")).alias("host"), kind.alias("page_type"), (size % 6).alias("blocks"), F.col("p_type").alias("industry"),
        F.col("p_brand").alias("platform"), F.col("p_name").alias("theme"), (size % 3).cast("string").alias("country"), F.nullif(key % 9, F.lit(0)).alias("rank"),
    )


@query(
    f"WITH p AS ({PART_PAGES}), f AS (SELECT * FROM p WHERE page_type = 'product' AND host <> 'Brand#2-0' AND blocks > 0 QUALIFY row_number() OVER (PARTITION BY host ORDER BY seq) = 1) "
    "SELECT host, (CASE WHEN industry = 'ECONOMY' THEN 4 ELSE 0 END + CASE WHEN platform = 'Brand#2' THEN 2 ELSE 0 END + CASE WHEN theme = 'small ring' THEN 1 ELSE 0 END + CASE WHEN country = '1' THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM f ORDER BY score DESC, rank NULLS LAST, host LIMIT 12"
)
def similar_pages(spark, sf_dir):
    """The first product page of each other store, by what its store has in common."""
    target = {"page_type": "product", "host": "Brand#2-0", "industry": "ECONOMY", "platform": "Brand#2", "theme": "small ring", "country": "1"}
    return ranking.similar_pages(part_pages(spark, sf_dir), target).select("host", "score")


@query("SELECT p_partkey, round((CASE WHEN p_brand = 'Brand#3' THEN 4 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 2 ELSE 0 END + CASE WHEN p_name = 'small ring' THEN 1 ELSE 0 END + greatest(0, 1 - abs(log2((p_size + 1) / 10.0))))::DOUBLE, 9) AS score FROM part")
def block_similarity(spark, sf_dir):
    """Points for colour, page type, platform and shape."""
    target = {"colour": "Brand#3", "page_type": "ECONOMY", "platform": "small ring", "ratio": 10.0}
    score = ranking.block_similarity(target, F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size") + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 9).alias("score"))


@query("SELECT host, min(seq) AS seq FROM (" + PART_PAGES + ") GROUP BY 1 ORDER BY seq LIMIT 25")
def first_by_target(spark, sf_dir):
    """The first of the rows that lead to one host, 25 in order."""
    return dedup.first_by_target(part_pages(spark, sf_dir), "host", "seq", 25).select("host", "seq")


@query(f"SELECT seq, page_type FROM ({PART_PAGES}) WHERE blocks <> 0 QUALIFY row_number() OVER (PARTITION BY page_type ORDER BY seq) <= CASE page_type WHEN 'home' THEN 1 WHEN 'product' THEN 3 ELSE 0 END")
def first_n_per_type(spark, sf_dir):
    """One home page and three products, empty ones left out."""
    return dedup.first_n_per_type(part_pages(spark, sf_dir), "page_type", "seq", {"home": 1, "product": 3}, F.col("blocks") == 0).select("seq", "page_type")


@query(
    f"WITH p AS ({PART_PAGES}), b AS (SELECT host, seq, 0 AS p FROM p WHERE page_type = 'home' AND seq < 60 UNION ALL SELECT host, seq, 1 FROM p WHERE page_type <> 'home'), k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY host ORDER BY p, seq) = 1) SELECT host, seq FROM k ORDER BY p, seq LIMIT 30"
)
def preferred_then_fill(spark, sf_dir):
    """Home pages first, then others until there are thirty hosts."""
    rows = part_pages(spark, sf_dir)
    return dedup.preferred_then_fill(rows.where("page_type = 'home' AND seq < 60"), rows.where("page_type <> 'home'"), "host", "seq", 30).select("host", "seq")


@query("WITH g AS (SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 * 60 AS y FROM lineitem) SELECT l_orderkey, l_linenumber, y::INTEGER AS y FROM g WHERE y < 100 AND y + 50 > 20")
def visible_frames(spark, sf_dir):
    """Frames of a wall that meet a window."""
    grid = layout.wall_grid(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber"], 3, 100, 50, 10).withColumn("height", F.lit(50))
    return layout.visible(grid, "y", "height", 20, 100).select("l_orderkey", "l_linenumber", F.col("y").cast("int").alias("y"))


@query(
    "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey <= 500) ORDER BY c_nationkey DESC, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END, nullif(c_custkey % 4, 0), c_name LIMIT 20"
)
def queue_claims(spark, sf_dir):
    """The next twenty of a queue: priority, ranked before unranked, rank, host; only those whose time has come."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 5 != 0, "pending").otherwise("done").alias("status"), F.when(key % 3 == 0, key).alias("next_try_at"), F.col("c_nationkey").alias("priority"), F.nullif(key % 4, F.lit(0)).alias("rank"), F.col("c_name").alias("host")
    )
    return mutations.claim_next(rows, ranking.claim_order("priority", "rank", "host"), F.lit(500), 20).select("c_custkey")


CANDIDATES = "SELECT source AS host, nullif(min(doc_id) % 5, 0) AS rank, count(*) AS mentions, list(DISTINCT lang) AS sources FROM documents GROUP BY 1"


@query(f"WITH c AS ({CANDIDATES}) SELECT host, row_number() OVER (ORDER BY rank NULLS LAST, CASE WHEN rank IS NULL THEN -mentions END, CASE WHEN rank IS NULL THEN -len(sources) END, host) AS n FROM c QUALIFY n <= 10")
def candidate_ranking(spark, sf_dir):
    """Ranked hosts by rank, the others by mentions and sources."""
    rows = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("host")).agg(F.nullif(F.min("doc_id") % 5, F.lit(0)).alias("rank"), F.count("*").alias("mentions"), F.collect_set("lang").alias("sources"))
    return paging.numbered(rows, ranking.candidate_order("rank", "mentions", "sources", "host"), 10, 0).select("host", "n")


@query(
    "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 5 >= 3 THEN 0 WHEN s_suppkey % 5 = 2 THEN 1 ELSE 2 END, nullif(s_nationkey, 3) NULLS LAST, s_acctbal DESC, s_name) AS n FROM supplier QUALIFY n <= 40"
)
def evidence_ranking(spark, sf_dir):
    """Seeds by tier of evidence, traffic rank, mentions and host."""
    rows = table(spark, sf_dir, "supplier").withColumn("strong", F.col("s_suppkey") % 5).withColumn("rank", F.nullif("s_nationkey", F.lit(3)))
    return paging.numbered(rows, ranking.evidence_order("strong", "rank", "s_acctbal", "s_name"), 40, 0).select("s_suppkey", "n")


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer UNION ALL SELECT n_nationkey, n_name FROM nation")
def union_of_tables(spark, sf_dir):
    frames = [table(spark, sf_dir, t).select(F.col(k).cast("long").alias("key"), F.col(n).alias("name")) for t, k, n in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"))]
    return mutations.union_all(frames)


@query("SELECT lang AS value FROM documents UNION SELECT source FROM documents UNION SELECT event_type FROM events")
def union_of_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mutations.union_distinct([docs.select(F.col("lang").alias("value")), docs.select(F.col("source").alias("value")), table(spark, sf_dir, "events").select(F.col("event_type").alias("value"))])


@query(
    "WITH l AS (SELECT user_id AS board_id, event_id % 4 AS block_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' WHEN 'view' THEN 'note' ELSE 'add' END AS kind, 'note ' || event_id AS note FROM events), "
    "s AS (SELECT board_id, block_id, arg_max(kind, seq) FILTER (WHERE kind <> 'note') AS last, max(seq) FILTER (WHERE kind = 'remove') AS gone, min(seq) FILTER (WHERE kind = 'add') AS added, arg_max(note, seq) FILTER (WHERE kind = 'note') AS note, max(seq) FILTER (WHERE kind = 'note') AS noted, max(seq) AS updated FROM l GROUP BY 1, 2) "
    "SELECT board_id, block_id, added, updated, CASE WHEN gone IS NULL OR noted > gone THEN substr(note, 1, 7) END AS note FROM s WHERE last = 'add'"
)
def board_state(spark, sf_dir):
    """What boards hold after a log of additions, notes and removals."""
    kind = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "view", "note").otherwise("add")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("board_id"), (F.col("event_id") % 4).alias("block_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
    return mutations.board_items(log, most=7)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 UNION SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 500 = 1")
def own_and_borrowed(spark, sf_dir):
    """Orders of a customer and orders by key that are not theirs already."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return mutations.own_and_borrowed(orders.where("o_custkey = 7"), orders.where("o_orderkey % 500 = 1"), "o_orderkey", "o_orderdate").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')")
def values_outside(spark, sf_dir):
    """Rows whose value is not allowed."""
    return mutations.outside(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascaded_delete(spark, sf_dir):
    """Lines left after their orders are deleted."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return mutations.cascade(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query(
    "WITH a AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT // 30 AS step, event_type IN ('view', 'click') AS good FROM events), n AS (SELECT *, max(step) FILTER (WHERE good) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a), "
    "g AS (SELECT *, good AND (newest IS NULL OR step > newest) AS ok FROM n), w AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wrong FROM g) "
    "SELECT event_id, CASE WHEN wrong >= 5 THEN 'ended' WHEN ok THEN 'ok' ELSE 'wrong' END AS outcome FROM w"
)
def two_step_outcomes(spark, sf_dir):
    """Outcomes of code attempts: a step counts once, five wrong ones end a session."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 30).alias("step"), F.col("event_type").isin("view", "click").alias("right"))
    return state.two_step(rows, "user_id", "event_id", "step", "right").select("event_id", "outcome")


@query(
    "WITH r AS (SELECT user_id, event_id, floor(epoch(ts)) AS ready, least(greatest(coalesce(value / 10, 0), 1), 10) AS wait FROM events), t AS (SELECT *, coalesce(sum(wait) OVER (PARTITION BY user_id ORDER BY ready, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) "
    "SELECT user_id, count(*) AS n, round(max(start), 3) AS last_start FROM (SELECT user_id, max(ready - before) OVER (PARTITION BY user_id ORDER BY ready, event_id ROWS UNBOUNDED PRECEDING) + before AS start FROM t) GROUP BY 1"
)
def request_pacing(spark, sf_dir):
    """When the last request of each host may start; ties in time end at the same moment in any order."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ready"), (F.col("value") / 10).alias("delay"))
    return state.pacing(rows, "user_id", "ready", "delay").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("start"), 3).alias("last_start"))


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND event_type <> 'error'")
def fresh_cache(spark, sf_dir):
    """Cached rows of the last ten days, transient verdicts left out."""
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").cast("timestamp").alias("m")).first()["m"]
    return state.fresh(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.lit(now), 10, F.col("event_type") == "error").select("event_id")


@query("SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_answers(spark, sf_dir):
    """The latest answer of each key that is not pending."""
    rows = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "view", "pending").otherwise("done"))
    return state.latest_answers(rows, ["user_id"], "status", "ts", "event_id").select("user_id", "event_id", "event_type")


MATRIX = {"search": ["signed out", "free", "pro", "team"], "boards": ["free", "pro", "team"], "export": ["pro", "team"], "share": ["team"]}


@query(
    "SELECT event_id, CASE event_type WHEN 'signup' THEN 'search,boards,export' WHEN 'purchase' THEN 'search,boards,export,share' WHEN 'view' THEN 'search,boards' WHEN 'error' THEN 'search' ELSE '' END AS features, event_type IN ('signup', 'purchase') AS can_export FROM events"
)
def entitlements(spark, sf_dir):
    """What a plan may do; signed out is no plan, unknown plans may nothing."""
    kind = F.col("event_type")
    plan = F.when(kind == "signup", "pro").when(kind == "purchase", "team").when(kind == "view", "free").when(kind != "error", "odd")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(state.features_for(plan, MATRIX), ",").alias("features"), state.can(plan, MATRIX, "export").alias("can_export"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(' ' || lower(p_name) || ' ', ' small ') AND regexp_matches(' ' || lower(p_type) || ' ', ' economy ')")
def stores_by_words(spark, sf_dir):
    """Rows that have every word of a query as a word."""
    return table(spark, sf_dir, "part").where(facets.contains_all_words([F.col("p_name"), F.col("p_type")], "Small economy")).select("p_partkey")


@query(
    "WITH s AS (SELECT c_custkey, c_name, nullif(c_acctbal > 0, false) AS has, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS rank FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1')) SELECT c_custkey, row_number() OVER (ORDER BY rank NULLS LAST, c_name) AS n, (SELECT count(*) FROM s) AS total FROM s QUALIFY n BETWEEN 11 AND 60"
)
def stores_list(spark, sf_dir):
    """A page of stores under optional filters and a text, by rank with those without one last, and the total."""
    found = facets.listed(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}, [F.col("c_name")], "1")
    rows = found.withColumn("rank", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return paging.with_total(paging.numbered(rows, paging.nulls_last(["rank", "c_name"]), 50, 10), rows).select("c_custkey", "n", "total")


@query(
    "WITH b AS (SELECT l_orderkey AS id, p_brand AS host, l_returnflag AS viewport, CASE WHEN p_size % 3 = 0 THEN p_type || '-part' ELSE p_type END AS kind, p_name AS url, l_linenumber AS idx, p_size, l_orderkey * 10 + l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "k AS (SELECT seq FROM b WHERE p_size <> 7 QUALIFY row_number() OVER (PARTITION BY host, viewport, regexp_replace(kind, '-part$', '') ORDER BY CASE WHEN kind LIKE '%-part' THEN 1 ELSE 0 END, url, idx, seq) = 1) SELECT seq FROM k UNION ALL SELECT seq FROM b WHERE p_size = 7"
)
def shown_in_order(spark, sf_dir):
    """One block per section; blocks of one size are exempt and all stay."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        F.col("p_brand").alias("host"), F.col("l_returnflag").alias("viewport"), F.lit("home").alias("page_type"), F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit("-part"))).otherwise(F.col("p_type")).alias("block_type"),
        F.lit(None).cast("string").alias("type_hint"), F.col("p_name").alias("url"), F.col("l_linenumber").alias("block_index"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "p_size",
    )
    return dedup.shown_in_order(rows, "id", F.col("p_size") == 7).select(F.col("id").alias("seq"))
