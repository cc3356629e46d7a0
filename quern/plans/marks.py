"""Detection over pages that show something: the test pages with marks of shops at their ends, and rows that are missing something."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import detect, fixed
from quern.operators import joins, mutations, state
from quern.plans.registry import query, table
from quern.sources import files

_SHOP = '<script src="//CDN.shopify.com/x"></script>Shopify.theme = {"name":"Dawn copy","schema_name":"Dawn","schema_version":"9.0.1"}; Shopify.currency = {"active":"EUR","rate":"1"} Shopify.country = "DE" Shopify.locale = "de"'
#: What is appended to a page, and what it shows then: platform, theme, version, currency, country, locale (none: the page's own).
MARKED = (
    ("", None, None, None, None, None, None),
    (_SHOP, "shopify", "Dawn", "9.0.1", "EUR", "DE", "de"),
    ('<link href="/wp-content/themes/Storefront/style.css"> WooCommerce "priceCurrency": "USD"', "woocommerce", "storefront", None, "USD", None, None),
    ('<link href="/wp-content/themes/twentytwo/a.css">', "wordpress", "twentytwo", None, None, None, None),
    ('<script src="/static/version17/frontend/Mage/x.js"></script>', "magento", None, None, None, None, None),
    ("Static.SQUARESPACE.com sqs-cart", "squarespace-commerce", None, None, None, None, None),
    ("static.wixstatic.com", "wix", None, None, None, None, None),
    ('Shopify.theme = {"name":"Mine"}; "priceCurrency":"GBP"', "shopify", "Mine", None, "GBP", None, None),
)


def _q(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def marked_pages(spark, sf_dir):
    tails = F.array(*[F.lit(m[0]) for m in MARKED])
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", F.get(tails, (F.col("page_id") % len(MARKED)).cast("int"))).alias("html"))


_PICK = lambda k: "[" + ", ".join(_q(m[k]) for m in MARKED) + f"][page_id % {len(MARKED)} + 1]"


@query(f"SELECT page_id, {_PICK(1)} AS platform, {_PICK(2)} AS theme, {_PICK(3)} AS theme_version, {_PICK(4)} AS currency, {_PICK(5)} AS country, coalesce({_PICK(6)}, nullif(regexp_extract(html, '<html[^>]*\\slang=\"([a-zA-Z]{{2}}(-[a-zA-Z]{{2}})?)\"', 1), '')) AS locale FROM pages")
def marked_fingerprints(spark, sf_dir):
    """Platform, theme, version, currency, country and locale of pages with marks."""
    found = marked_pages(spark, sf_dir).select("page_id", detect.fingerprint(F.col("html")).alias("f"))
    return found.select("page_id", *[f"f.{c}" for c in ("platform", "theme", "theme_version", "currency", "country", "locale")])


_APP_TAILS = ("static.klaviyo.com", "rechargeapps.com rebuyengine", "GORGIAS loopwork.co", "", "skio.com/x _learnq")


@query(
    "WITH p AS (SELECT page_id, html || [" + ", ".join(map(_q, _APP_TAILS)) + f"][page_id % {len(_APP_TAILS)} + 1] AS html FROM pages) SELECT page_id, array_to_string([x FOR x IN ["
    + ", ".join(f"CASE WHEN regexp_matches(html, {_q('(?i)' + p)}) THEN {_q(n)} END" for n, p in fixed.APP_PATTERNS)
    + "] IF x IS NOT NULL], '|') AS apps FROM p"
)
def marked_apps(spark, sf_dir):
    """All known apps by their patterns, on pages that have some."""
    tails = F.array(*map(F.lit, _APP_TAILS))
    html = F.concat("html", F.get(tails, (F.col("page_id") % len(_APP_TAILS)).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(detect.apps(html), "|").alias("apps"))


@query(
    "SELECT page_id, unnest(CASE page_id % 3 WHEN 0 THEN ['a' || page_id || '.example', 'shop.example'] WHEN 1 THEN ['shop.example'] ELSE [] END) AS host FROM pages"
)
def marked_links(spark, sf_dir):
    """Hosts that pages with links at their ends lead to: each once a page, own links and what is no host left out."""
    n = F.col("page_id")
    tail = F.when(n % 3 == 0, F.concat(F.lit('<a href="https://www.A'), n.cast("string"), F.lit('.example/x">'))).otherwise("")
    links = F.concat(tail, F.when(n % 3 < 2, '<a href="http://shop.example/a"><a href="https://shop.example/b"><a href="https://own.example/c"><a href="http://localhost/d"><a href="/e">').otherwise('<a href="https://own.example/">'))
    pages = table(spark, sf_dir, "pages").select("page_id", links.alias("html"))
    return files.outbound_links(pages, "page_id", "html", F.lit("own.example"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def orphan_orders(spark, sf_dir):
    """Orders whose customer is in no list of one segment."""
    listed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return mutations.orphans(table(spark, sf_dir, "orders"), listed, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey AS c_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def left_lookup(spark, sf_dir):
    """All orders with what is known of their customers, those without an account in credit unknown."""
    dim = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    return joins.lookup(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), dim, "c_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_name", "c_mktsegment")


@query(
    "WITH RECURSIVE r AS (SELECT 'e' || event_id % 900 AS event_id, event_id * 7919 % 1000003 AS arrival, CASE WHEN user_id % 11 <> 0 THEN user_id::VARCHAR END AS user_id, 's' || event_id % 2 AS subscription, event_type <> 'error' AS keeps, "
    "CASE WHEN event_type = 'click' THEN 'other' ELSE 'pro' END AS price, epoch(date_trunc('second', ts))::BIGINT AS occurred_at, event_type <> 'view' AS relevant FROM events), "
    "d AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_id ORDER BY arrival) > 1 THEN 'duplicate' WHEN NOT relevant THEN 'ignored' WHEN user_id IS NULL THEN 'unmatched' END AS plain FROM r), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival) AS n FROM d WHERE plain IS NULL), "
    "f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS upto, NULL::VARCHAR AS sub, NULL::VARCHAR AS event_id, NULL::BIGINT AS arrival, '' AS outcome FROM t UNION ALL "
    "SELECT user_id, n, CASE WHEN starts_with(outcome, 'applied') THEN occurred_at ELSE upto END, CASE WHEN NOT starts_with(outcome, 'applied') THEN sub WHEN keeps THEN subscription END, event_id, arrival, outcome FROM ("
    "SELECT t.*, f.upto, f.sub, CASE WHEN f.upto IS NOT NULL AND t.occurred_at < f.upto THEN 'stale' WHEN f.sub IS NOT NULL AND f.sub <> t.subscription AND NOT keeps THEN 'other_subscription' WHEN keeps AND price <> 'pro' THEN 'unknown_price' WHEN keeps THEN 'applied:pro' ELSE 'applied:free' END AS outcome "
    "FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)) "
    "SELECT event_id, arrival, outcome FROM f WHERE n > 0 UNION ALL SELECT event_id, arrival, plain FROM d WHERE plain IS NOT NULL"
)
def subscription_ledger(spark, sf_dir):
    """Outcomes of subscription events in the order of their arrival: late ones, repeated ones, those of another subscription."""
    n, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), (n % 900).cast("string")).alias("event_id"),
        (n * 7919 % 1000003).alias("arrival"),
        F.when(F.col("user_id") % 11 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("s"), (n % 2).cast("string")).alias("subscription"),
        F.when(kind == "error", "canceled").otherwise("active").alias("status"),
        F.when(kind == "click", "other").otherwise("pro").alias("price"),
        F.lit(3).alias("quantity"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("occurred_at"),
        (kind != "view").alias("relevant"),
    )
    return state.subscription_outcomes(rows, plans={"pro": "pro"}).select("event_id", "arrival", "outcome")
