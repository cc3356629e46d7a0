"""Capture documents and what becomes of them: the rows of sites, pages, captures and blocks, and the lists made from them.

Orders stand for captures and their lines for blocks; each document goes through
its JSON text, as if read from a file.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import schemas
from quern.functions import text
from quern.operators import facets, layout, search
from quern.plans.registry import query, table
from quern.sources import files, manifests

DOCUMENTS_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_quantity) AS l_quantity, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, 'h' || o_custkey % 40 || '.example' AS host, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%SZ') AS seen FROM orders),
m AS (SELECT *, 'https://' || CASE WHEN o_custkey % 5 = 0 THEN 'www.other.example' ELSE host END || CASE WHEN o_custkey % 3 = 0 THEN '/en-gb' ELSE '' END || '/p/' || o_custkey AS url, CASE WHEN o_orderstatus = 'F' THEN 'home' ELSE 'product' END AS page_type, 't ' || o_orderpriority AS title, nullif(o_orderstatus, 'P') AS platform,
  CASE o_orderkey % 3 WHEN 0 THEN 'Dawn' WHEN 1 THEN 'Sense' END AS theme FROM o),
i AS (SELECT m.*, sha1(host || chr(1) || url) AS page_id FROM m), c AS (SELECT i.*, sha1(page_id || chr(1) || seen) AS capture_id FROM i),
b AS (SELECT c.host, c.url, c.seen, c.page_type, c.title AS page_title, c.page_id, c.capture_id, c.o_orderkey, l_linenumber AS block_index, CASE WHEN l_linenumber % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS viewport, lower(l_returnflag) AS type_hint, CAST(floor(l_quantity * 1.5 + 0.5) AS INTEGER) AS height, 'text ' || l_partkey AS text, CASE WHEN l_suppkey % 2 = 0 THEN 'head ' || l_suppkey END AS headline, CASE WHEN l_partkey % 4 <> 0 THEN 'f' || l_linenumber || '.png' END AS file FROM c JOIN l ON l_orderkey = o_orderkey)
"""


def documents(spark, sf_dir, with_blocks=True):
    """Documents by way of their JSON, with the folder each would lie in; without blocks for what is made from their heads alone."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    host = F.concat(F.lit("h"), (cust % 40).cast("string"), F.lit(".example"))
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + key % 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.concat(F.lit("https://"), F.when(cust % 5 == 0, "www.other.example").otherwise(host), F.when(cust % 3 == 0, "/en-gb").otherwise(""), F.lit("/p/"), cust.cast("string"))
    block = F.struct(
        F.col("l_linenumber").alias("index"), F.lower("l_returnflag").alias("typeHint"), (F.col("l_quantity") * 1.5).alias("height"), F.lit(-2.5).alias("top"), F.lit(100.0).alias("width"), F.concat(F.lit("te\u0000xt "), F.col("l_partkey").cast("string")).alias("text"),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("head "), F.col("l_suppkey").cast("string"))).otherwise("").alias("headline"), F.when(F.col("l_linenumber") % 2 == 0, "mobile").otherwise("desktop").alias("viewport"),
        F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(".png"))).alias("file"), (F.col("l_linenumber") % 3).alias("buttons"),
    )
    # dealt out once, by what both groupings and the join agree on
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_quantity", "l_partkey", "l_suppkey")])
    blocks = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    theme = F.when(key % 3 == 0, '{"name": "Dawn"}').when(key % 3 == 1, '{"schema_name": "Sense"}')
    site = F.struct(host.alias("host"), F.nullif("o_orderstatus", F.lit("P")).alias("platform"), theme.alias("theme"), F.array(F.concat(F.lit("app"), (key % 4).cast("string"))).alias("apps"))
    page = F.struct(url.alias("url"), F.when(F.col("o_orderstatus") == "F", "home").otherwise("product").alias("type"), at.alias("capturedAt"), F.concat(F.lit("t\u0000 "), F.col("o_orderpriority")).alias("title"))
    view = F.struct(F.when(key % 6 == 0, "timeout").alias("error"))
    folder = F.concat(F.lit("/data/"), host, F.lit("/"), key.cast("string")).alias("folder")
    orders = table(spark, sf_dir, "orders")
    made = (orders.join(blocks, "o_orderkey", "left") if with_blocks else orders.withColumn("blocks", F.array().cast(blocks.schema["blocks"].dataType))).select(
        "o_orderkey", folder, F.to_json(F.struct(site.alias("site"), page.alias("page"), F.struct(view.alias("desktop")).alias("viewports"), F.coalesce("blocks", F.array()).alias("blocks"))).alias("document")
    )
    return made.select("o_orderkey", F.from_json("document", schemas.struct(schemas.MANIFEST)).alias("d"), "folder").select("o_orderkey", "d.*", "folder")


@query(DOCUMENTS_SQL + "SELECT page_id, host, url, page_type, title FROM c QUALIFY row_number() OVER (PARTITION BY host, url ORDER BY seen DESC) = 1")
def manifest_pages(spark, sf_dir):
    """Pages with the facts of their last capture."""
    return manifests.page_rows(documents(spark, sf_dir)).select("page_id", "host", "url", "page_type", "title")


@query(
    DOCUMENTS_SQL + "SELECT host, arg_max(platform, seen) FILTER (WHERE platform IS NOT NULL) AS platform, arg_max(theme, seen) FILTER (WHERE theme IS NOT NULL) AS theme, array_to_string(list_sort(list(DISTINCT 'app' || o_orderkey % 4)), ',') AS apps, coalesce(arg_max(title, seen) FILTER (WHERE page_type = 'home'), arg_min(title, seen)) AS title FROM c GROUP BY 1"
)
def manifest_sites(spark, sf_dir):
    """Sites by upsert over their documents."""
    return manifests.site_rows(documents(spark, sf_dir)).select("host", "platform", "theme", F.array_join("apps", ",").alias("apps"), "title")


@query(DOCUMENTS_SQL + "SELECT DISTINCT capture_id, page_id, epoch(seen::TIMESTAMP)::BIGINT AS captured FROM c")
def manifest_captures(spark, sf_dir):
    """One capture a page and time, though documents are read twice."""
    docs = documents(spark, sf_dir)
    return manifests.capture_rows(docs.union(docs)).select("capture_id", "page_id", F.unix_seconds("captured_at").alias("captured"))


BLOCK_ID = "sha1(capture_id || chr(1) || viewport || chr(1) || block_index)"


@query(DOCUMENTS_SQL + f"SELECT {BLOCK_ID} AS id, capture_id, viewport, block_index, type_hint, -2 AS top, height, text, headline FROM b")
def manifest_blocks(spark, sf_dir):
    """Blocks with geometry rounded half up, no NUL characters, and no empty headlines."""
    return manifests.block_rows(documents(spark, sf_dir)).select("id", "capture_id", "viewport", "block_index", "type_hint", "top", "height", "text", "headline")


@query(DOCUMENTS_SQL + "SELECT host, url, o_orderkey % 6 = 0 AS viewport_failed, o_orderkey IN (SELECT l_orderkey FROM l WHERE l_partkey % 4 = 0) AS block_without_image, o_custkey % 5 = 0 AS redirected_host, o_custkey % 3 = 0 AS region_in_path, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS no_blocks, platform IS NULL AS platform_unknown, theme IS NULL AS no_theme_info FROM c")
def manifest_edges(spark, sf_dir):
    """What is odd about each document."""
    return manifests.edge_cases(documents(spark, sf_dir))


@query(DOCUMENTS_SQL + "SELECT host, count(*) AS pages, min(url) AS first FROM c GROUP BY 1")
def manifest_index(spark, sf_dir):
    """One index text per host."""
    made = manifests.index_document(documents(spark, sf_dir))
    return made.select("host", F.json_array_length(F.get_json_object("document", "$.pages")).cast("long").alias("pages"), F.get_json_object("document", "$.pages[0].url").alias("first"))


@query(DOCUMENTS_SQL + "SELECT host || '/' || o_orderkey || '/' || viewport || '/' || block_index AS id, host, page_type, type_hint, substr(text, 1, 7) AS text, file FROM b WHERE file IS NOT NULL")
def manifest_samples(spark, sf_dir):
    """Blocks that have an image, their texts cut."""
    return manifests.sample_items(documents(spark, sf_dir), 7)


@query(
    DOCUMENTS_SQL + f", s AS (SELECT host, arg_max(platform, seen) FILTER (WHERE platform IS NOT NULL) AS platform FROM c GROUP BY 1), p AS (SELECT page_id, title FROM c QUALIFY row_number() OVER (PARTITION BY host, url ORDER BY seen DESC) = 1)"
    f"SELECT {BLOCK_ID} AS id, d.host, p.title AS page_title, s.platform, file AS src, block_index % 3 AS buttons, 0 AS images, text FROM b d JOIN s ON s.host = d.host JOIN p ON p.page_id = d.page_id"
)
def api_blocks(spark, sf_dir):
    """The projection of blocks that an API answers with."""
    docs, heads = documents(spark, sf_dir), documents(spark, sf_dir, with_blocks=False)
    found = manifests.api_items(manifests.block_rows(docs), manifests.capture_rows(heads), manifests.page_rows(heads), manifests.site_rows(heads))
    return found.select("id", "host", "page_title", "platform", "src", "buttons", "images", "text")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS width FROM part")
def image_facts(spark, sf_dir):
    """Blocks with the facts of their image, where there are any."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("folder"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("file"), "p_size")
    image = F.struct(F.col("p_size").alias("width"))
    sidecars = rows.where("p_partkey % 3 = 0").groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("file", image))).alias("images"))
    return manifests.with_images(rows, sidecars, "folder", "file").select("p_partkey", F.col("image.width").alias("width"))


@query(
    "WITH s AS (SELECT s_suppkey, s_name AS host, CASE s_suppkey % 4 WHEN 0 THEN 'x.myshopify.com' WHEN 1 THEN 'final.example' END AS final, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 50 END AS rank FROM supplier) "
    "SELECT host, CASE WHEN final = 'final.example' THEN final ELSE host END AS display_host, row_number() OVER (ORDER BY rank NULLS LAST, host) AS n, rank FROM s"
)
def stores_export(spark, sf_dir):
    """Stores in rank order with the host to show."""
    n = F.col("s_suppkey")
    final = F.when(n % 4 == 0, "x.myshopify.com").when(n % 4 == 1, "final.example").otherwise("")
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("host"), final.alias("final_host"), F.when(n % 3 > 0, (n % 50).cast("string")).otherwise("").alias("tranco_rank"), F.lit("a| |b").alias("apps"))
    seeds = seeds.withColumn("final_host", F.nullif("final_host", F.lit("")))
    return files.stores_export(seeds).select("host", "display_host", "n", F.col("tranco_rank").alias("rank"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'declared' WHEN 1 THEN 'main-hero' WHEN 2 THEN 'footer' WHEN 3 THEN 'navigation' ELSE 'unknown' END AS hint, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '-') ELSE 'block' END AS slug FROM part")
def section_hints(spark, sf_dir):
    """Section types of elements and slugs of names."""
    n = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (n % 5).cast("int"))
    hint = text.section_hint(pick(("Declared", "", "", "", "")), pick(("x", "shopify-section-template--12__main_hero", "x", "x", "x")), pick(("div", "div", "FOOTER", "nav", "div")), pick(("c", "c", "c", "c", "c")))
    return table(spark, sf_dir, "part").select("p_partkey", hint.alias("hint"), text.slugify(F.when(n % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"), F.lit("!"))).otherwise("***")).alias("slug"))


@query("SELECT p_partkey, contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'small') AS relevant, CASE WHEN p_size % 2 = 0 THEN p_size / 10.0 ELSE 1.5 END AS ratio FROM part")
def judged_blocks(spark, sf_dir):
    """A judge's verdict, and the shape of a page, its own or that of its blocks."""
    size = F.col("p_size")
    ratio = layout.page_view_ratio(F.when(size % 2 == 0, 10).otherwise(0), size, F.lit(1.5))
    return table(spark, sf_dir, "part").select("p_partkey", search.relevant(F.col("p_name"), ["RING"], ["small"]).alias("relevant"), ratio.alias("ratio"))


@query("WITH c AS (SELECT 'brand' AS key, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2) SELECT * FROM c ORDER BY key, n DESC, value LIMIT 9")
def facet_order(spark, sf_dir):
    """The first entries in facet order: key, count, value."""
    counts = facets.facet_counts(table(spark, sf_dir, "part"), {"brand": facets.Facet(F.col("p_brand")), "type": facets.Facet(F.col("p_type"))}, facets.Filters()).where("key <> '#total'")
    return facets.ordered(counts).limit(9)
