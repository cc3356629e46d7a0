"""Addresses, pages and answers: the detection, verdict and text rules with their real values, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import colour, detect, fixed, tags, text
from quern.operators import facets, paging, profiles, search
from quern.plans.registry import query, table
from quern.sources import files, manifests


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _find(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_sql(pattern)})"


def _first(column: str, marks, low: bool = True) -> str:
    hay = f"lower({column})" if low else column
    return "CASE " + " ".join(f"WHEN contains({hay}, {_sql(m)}) THEN {_sql(m)}" for m in marks) + " END"


TITLE = "coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')"


def _title():
    return F.regexp_extract("html", r"<title>([^<]*)</title>", 1)


@query("SELECT page_id, nullif(list_filter([" + ", ".join(f"CASE WHEN {_find('html', '(?i)' + p)} THEN {_sql(n)} END" for n, p in fixed.APP_PATTERNS) + "], lambda x: x IS NOT NULL), []) AS apps FROM pages")
def page_apps(spark, sf_dir):
    """Apps by all the patterns; null if none is found."""
    found = table(spark, sf_dir, "pages").select("page_id", detect.apps(F.col("html")).alias("apps"))
    return found.select("page_id", F.when(F.size("apps") > 0, F.col("apps")).alias("apps"))


WALLED = "(SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '<p>Sorry, you have been blocked</p>' WHEN 1 THEN 'We do not ship to your country' WHEN 2 THEN '<h1>An error has occurred</h1>' WHEN 3 THEN 'Please select your country' WHEN 4 THEN 'Verify you are a human' ELSE html END AS html FROM pages))"


@query(f"SELECT page_id, CASE WHEN length(t) > 1500 THEN NULL " + " ".join(f"WHEN {_find(chr(39) + ' ' + chr(39) + ' || t', '(?i)' + p)} THEN {_sql(k)}" for k, p in fixed.WALL_PATTERNS) + f" END AS wall FROM {WALLED}")
def wall_kinds(spark, sf_dir):
    """Pages that stand in for the page asked for, all five kinds."""
    said = ("<p>Sorry, you have been blocked</p>", "We do not ship to your country", "<h1>An error has occurred</h1>", "Please select your country", "Verify you are a human")
    html = F.coalesce(*[F.when(F.col("page_id") % 7 == i, F.lit(s)) for i, s in enumerate(said)], F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", detect.wall(F.lit(""), F.regexp_replace(html, "<[^>]*>", " ")).alias("wall"))


SHOWN = "(SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 404 ELSE 200 END AS status, page_id % 11 <> 3 AS is_html, CASE page_id % 6 WHEN 0 THEN html || ' domain for sale' WHEN 1 THEN html || ' coming soon' ELSE html END AS html, CASE page_id % 8 WHEN 2 THEN 'Judi togel' WHEN 4 THEN 'Escort' ELSE 'Plain shop' END AS title, page_id % 4 <> 2 AS is_store FROM pages)"
SMALL = ", ".join(map(_sql, fixed.SMALL_PAGE_MARKS))


@query(
    f"SELECT page_id, CASE WHEN status IS NULL THEN 'dead' WHEN status < 200 OR status >= 400 THEN 'http-' || status WHEN NOT is_html THEN 'not-html' WHEN {_find(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39), '(?i)' + fixed.SPAM_TITLE)} THEN 'spam' "
    f"WHEN length(html) < 1500 OR (mark IS NOT NULL AND NOT (mark IN ({SMALL}) AND length(html) > 20000)) THEN 'parked' WHEN NOT is_store THEN 'not-store' WHEN {_first('title', fixed.ADULT_MARKS)} IS NOT NULL THEN 'adult' END AS reason FROM (SELECT *, {_first('html', fixed.PARKED_MARKS)} AS mark FROM {SHOWN})"
)
def rejections(spark, sf_dir):
    """The first reason to reject a fetched page."""
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(n % 5 == 1, 404).when(n % 5 != 0, 200).alias("status"),
        (n % 11 != 3).alias("is_html"),
        F.when(n % 6 == 0, F.concat("html", F.lit(" domain for sale"))).when(n % 6 == 1, F.concat("html", F.lit(" coming soon"))).otherwise(F.col("html")).alias("html"),
        F.when(n % 8 == 2, "Judi togel").when(n % 8 == 4, "Escort").otherwise("Plain shop").alias("title"),
        (n % 4 != 2).alias("is_store"),
    )
    return rows.select("page_id", detect.rejection(F.col("status"), F.col("is_html"), F.col("html"), F.col("title"), F.lit(None).cast("string"), F.col("is_store")).alias("reason"))


STORE = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'shopify' WHEN 1 THEN 'nextjs' END AS kind, p_partkey % 4 AS strong, p_partkey % 6 AS weak, CASE p_partkey % 5 WHEN 0 THEN 'Official online store' WHEN 1 THEN 'casino' ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN true ELSE false END AS listed FROM part"


@query(
    f"WITH s AS ({STORE}), f AS (SELECT *, {_find('title || ' + _sql(' '), '(?i)' + fixed.STORE_TITLE)} AS says, {_find('title || ' + _sql(' '), '(?i)' + fixed.SPAM_TITLE)} AS spam FROM s) "
    "SELECT p_partkey, NOT spam AND CASE WHEN kind = 'shopify' THEN strong >= 1 OR weak >= 2 OR listed OR says ELSE strong >= 2 OR (strong >= 1 AND weak >= 2) OR weak >= 4 OR (says AND (strong >= 1 OR weak >= 1 OR listed)) OR (listed AND strong >= 1) END AS is_store FROM f"
)
def store_verdicts(spark, sf_dir):
    """The store verdict over detected facts."""
    n = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 3 == 0, "shopify").when(F.col("p_size") % 3 == 1, "nextjs")
    title = F.when(n % 5 == 0, "Official online store").when(n % 5 == 1, "casino").otherwise(F.col("p_name"))
    sources = F.when(n % 7 == 0, F.array(F.lit("ecomm"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", detect.looks_like_store(kind, n % 4, n % 6, title, F.lit(None).cast("string"), sources).alias("is_store"))


@query(
    f"SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'listed' WHEN s_suppkey % 9 = 1 THEN 'spam' WHEN {_find('host', '(?i)' + fixed.ELSEWHERE_HOSTS)} THEN 'forwards elsewhere' WHEN s_suppkey % 2 = 0 AND s_nationkey % 2 = 0 THEN 'coming soon' END AS reason "
    "FROM (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN 'shop.etsy.com' WHEN 1 THEN 'www.amazon.co.uk' ELSE 'own.example' END AS host FROM supplier)"
)
def hold_backs(spark, sf_dir):
    """The first reason to hold a seed back."""
    n = F.col("s_suppkey")
    host = F.when(n % 4 == 0, "shop.etsy.com").when(n % 4 == 1, "www.amazon.co.uk").otherwise("own.example")
    reason = detect.hold_back(F.when(n % 9 == 0, "listed"), F.when(n % 9 == 1, "Sbobet").otherwise("shop"), F.lit(None).cast("string"), host, n % 2 == 0, F.col("s_nationkey") % 2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", reason.alias("reason"))


REASONS = ("dead", "page-timeout", "Target closed", "http-503", "http-404", "Timeout 30000ms exceeded", "no content")


@query("SELECT event_id, " + f"CASE WHEN {_find('r', '(?i)' + fixed.BROWSER_GONE)} THEN 'browser' WHEN {_find('r', '(?i)' + fixed.TRANSIENT)} THEN 'transient' WHEN r IS NOT NULL THEN 'final' END AS kind FROM (SELECT event_id, [{', '.join(map(_sql, REASONS))}, NULL][event_id % 8 + 1] AS r FROM events)")
def failure_kinds(spark, sf_dir):
    reason = F.get(F.array(*map(F.lit, REASONS), F.lit(None).cast("string")), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", detect.failure_kind(reason).alias("kind"))


@query(
    "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'blocked' WHEN s IS NULL THEN 'dead' WHEN s BETWEEN 200 AND 299 THEN CASE WHEN event_id % 2 = 0 THEN 'allow' ELSE 'deny' END WHEN s = 429 THEN CASE WHEN event_id % 3 = 0 THEN 'deny' ELSE 'allow' END WHEN s BETWEEN 400 AND 499 THEN 'allow' ELSE 'deny' END AS verdict "
    "FROM (SELECT event_id, [200, 404, 429, 500, NULL][event_id % 5 + 1] AS s FROM events)"
)
def robots_verdicts(spark, sf_dir):
    """What robots.txt means for a path, by how its fetch ended."""
    n = F.col("event_id")
    status = F.get(F.array(*[F.lit(x) for x in (200, 404, 429, 500)], F.lit(None).cast("int")), (n % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", detect.robots_verdict(status, F.when(n % 3 == 0, "/cart/x").otherwise("/products/x"), n % 13 == 0, n % 2 == 0).alias("verdict"))


@query(
    f"SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'skipped: password page' WHEN host <> 'own.example' AND {_find('host', '(?i)' + fixed.ELSEWHERE_HOSTS)} THEN 'skipped: forwards to ' || host WHEN s_nationkey = 3 THEN 'failed: no content' END AS outcome "
    "FROM (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN 'linktr.ee' ELSE 'own.example' END AS host FROM supplier)"
)
def redirect_outcomes(spark, sf_dir):
    n = F.col("s_suppkey")
    host = F.when(n % 4 == 0, "linktr.ee").otherwise("own.example")
    url = F.concat(F.lit("https://"), host, F.when(n % 6 == 0, "/password?x=1").otherwise("/"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", detect.redirect_outcome(url, F.lit("own.example"), host, F.when(F.col("s_nationkey") == 3, 0).otherwise(4)).alias("outcome"))


def _map_sql(d: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_sql(k)} THEN {_sql(v)}" for k, v in d.items()) + " END"


@query(
    f"WITH p AS (SELECT s_suppkey, ['a.co.uk', 'b.de', 'c.com', 'd.fr', 'e.com.au'][s_suppkey % 5 + 1] AS host, [NULL, 'EUR', 'SEK', 'XXX'][s_suppkey % 4 + 1] AS cur, [NULL, 'en-ca', 'fr'][s_suppkey % 3 + 1] AS loc, ['XK', 'NL'][s_suppkey % 2 + 1] AS vis FROM supplier) "
    f"SELECT s_suppkey, coalesce({_map_sql(fixed.ENDING_COUNTRY, chr(39) + chr(39) + ' || split_part(host, ' + _sql('.') + ', -2) || ' + _sql('.') + ' || split_part(host, ' + _sql('.') + ', -1)')}, {_map_sql(fixed.ENDING_COUNTRY, 'split_part(host, ' + _sql('.') + ', -1)')}, {_map_sql(fixed.CURRENCY_COUNTRY, 'cur')}, CASE WHEN regexp_matches(loc, '-[A-Za-z]{{2}}$') THEN upper(right(loc, 2)) END, nullif(vis, 'XK')) AS country FROM p"
)
def store_countries(spark, sf_dir):
    """Where a site is from: domain ending, currency, locale, then what it shows a visitor."""
    n = F.col("s_suppkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (n % len(xs)).cast("int"))
    found = detect.country(pick(("a.co.uk", "b.de", "c.com", "d.fr", "e.com.au")), pick((None, "EUR", "SEK", "XXX")), pick((None, "en-ca", "fr")), pick(("XK", "NL")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("country"))


TAXONOMY = {"block_type": ["hero", "faq"], "page_role": ["home", "product"], "industry": ["fashion", "home"], "style_tags": ["bold", "light", "dark", "minimal", "warm"]}
ANSWERS = (
    '{"block_type":"hero","page_role":"home","style_tags":["bold"],"industry":"home","description":"fine","patterns":["x"],"has_price":true,"has_reviews":false,"has_video":true}',
    '{"block_type":"nav","page_role":"home","style_tags":["bold","bold"],"industry":"home","description":" ","patterns":["x"],"has_price":true,"has_reviews":false,"has_video":true}',
    '{"block_type":"faq","page_role":"home","style_tags":[],"industry":"toys","description":"fine","patterns":[" "],"has_price":"maybe","has_reviews":false,"has_video":true,"more":1}',
    "no json",
)
ERRORS = (
    [],
    ["block_type is not in the taxonomy", "style_tags repeats a tag", "description is empty"],
    ["unexpected field more", "industry is not in the taxonomy", "style_tags needs 1-4 tags, got 0", "patterns must be non-empty strings", "has_price is not a boolean"],
    ["not an object"],
)
ERRORS_SQL = "[" + ", ".join("[" + ", ".join(map(_sql, e)) + "]::VARCHAR[]" for e in ERRORS) + "][event_id % 4 + 1]"


@query(f"SELECT event_id, {ERRORS_SQL} AS errors FROM events")
def tag_errors(spark, sf_dir):
    """What is wrong with answers, by the taxonomy."""
    answer = F.get(F.array(*map(F.lit, ANSWERS)), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", tags.tag_errors(answer, TAXONOMY).alias("errors"))


@query(
    f"WITH e AS (SELECT event_id, event_type, {ERRORS_SQL} AS errors FROM events) SELECT event_id, CASE WHEN event_type = 'error' THEN 'errored' WHEN event_type = 'view' THEN 'expired' WHEN event_id % 10 = 0 OR len(errors) > 0 THEN 'invalid' ELSE 'succeeded' END AS status, "
    "CASE WHEN event_type = 'error' THEN 'unknown' WHEN event_type = 'view' THEN 'expired before processing' WHEN event_id % 10 = 0 THEN 'refusal' WHEN len(errors) > 0 THEN array_to_string(errors, '; ') END AS error FROM e"
)
def answer_outcomes(spark, sf_dir):
    """Status and error of batch results."""
    kind = F.when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "view", "expired").otherwise("succeeded")
    answer = F.get(F.array(*map(F.lit, ANSWERS)), (F.col("event_id") % 4).cast("int"))
    stop = F.when(F.col("event_id") % 10 == 0, "refusal").otherwise("end_turn")
    found = table(spark, sf_dir, "events").select("event_id", tags.answer_outcome(kind, stop, tags.tag_errors(answer, TAXONOMY), F.lit(None).cast("string")).alias("o"))
    return found.select("event_id", "o.status", "o.error")


@query("SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '[/\\s].*$', ''), '#.*$', ''), '') AS host FROM pages")
def host_lines(spark, sf_dir):
    """Hosts of list lines with scheme, path and comment."""
    return table(spark, sf_dir, "pages").select("page_id", text.host_line(F.concat(F.lit("  "), F.col("url"), F.lit("  # note"))).alias("host"))


@query("SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '/[0-9]+')")
def sitemap_addresses(spark, sf_dir):
    """Distinct addresses of a sitemap that fit a pattern."""
    xml = table(spark, sf_dir, "pages").select(F.concat(F.lit("<url><loc> "), F.replace("url", F.lit(" "), F.lit("")), F.lit("\n</loc></url><loc>x</loc>")).alias("xml"))
    return files.sitemap_urls(xml, "xml", "/[0-9]+")


@query(
    "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"#]+)', 1), 1) AS seq FROM pages), u AS (SELECT page_id, seq, CASE WHEN href[1] = '/' THEN 'https://a.example' || href ELSE href END AS url FROM h), "
    "f AS (SELECT page_id, lower(regexp_replace(url, '[?/]+$', '')) AS key, min(seq) AS seq, arg_min(url, seq) AS url FROM u WHERE starts_with(url, 'https://a.example') GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS place, url FROM f QUALIFY place <= 3"
)
def page_links(spark, sf_dir):
    """The first three links within a site, variants of an address once."""
    return files.page_links(table(spark, sf_dir, "pages"), "page_id", "html", F.lit("https://a.example"), 3)


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'First' WHEN 'Brand#2' THEN 'Second' ELSE p_brand END AS label FROM part")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.label(F.col("p_brand"), {"Brand#1": "First", "Brand#2": "Second"}).alias("label"))


@query(
    "SELECT p_partkey, concat_ws(chr(10), 'type: ' || p_type, 'name: ' || p_name, CASE WHEN p_size > 20 THEN 'size: ' || p_size END) AS context, substr(p_type || ' block. ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE concat_ws('. ', p_brand, p_name) END, 1, 30) AS input, "
    "concat_ws(chr(10), 'A ' || replace(p_type, '-', ' ') || ' block.', 'Headline: ' || p_name, 'It has ' || concat_ws(', ', CASE WHEN p_size % 3 > 0 THEN p_size % 3 || ' buttons' END, p_size + 1 || ' images') || '.') AS brief FROM part"
)
def block_texts(spark, sf_dir):
    """The lines, the embedding input and the brief of a block."""
    size = F.col("p_size")
    context = text.block_context({"type": F.col("p_type"), "name": F.concat(F.lit(" "), F.col("p_name"), F.lit("\n")), "size": F.when(size > 20, size)})
    told = text.embedding_input(F.col("p_type"), F.when(size % 2 == 0, F.col("p_name")).otherwise(" "), F.col("p_brand"), F.col("p_name"), 30)
    brief = text.brief(F.col("p_type"), {"buttons": size % 3, "images": size + 1}, F.col("p_name"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", context.alias("context"), told.alias("input"), brief.alias("brief"))


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'b ' || s_suppkey END AS brand, replace(s_name, '#', '-') || '.webp' AS webp, replace(s_name, '#', '-') || '.slice-' || lpad((s_suppkey % 12)::VARCHAR, 3, '0') || '.webp' AS slice, CASE WHEN s_suppkey % 2 = 0 THEN 'thumb' || s_suppkey ELSE replace(s_name, '#', '-') || '.png' END AS shot, "
    "floor(s_acctbal - 0.5 + 0.5)::BIGINT AS rounded FROM supplier"
)
def derived_keys(spark, sf_dir):
    """Brands that fall back to the host, keys of derived files, thumbnails, and rounding half up."""
    n = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_name").alias("host"), F.when(n % 3 == 0, " ").otherwise(F.concat(F.lit("b "), n.cast("string"))).alias("brand"), F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(".png")).alias("file"))
    image = F.struct(F.when(n % 2 == 0, F.concat(F.lit("thumb"), n.cast("string"))).alias("thumbnailKey"))
    stem = manifests.image_keys(F.col("file"), "p")["webp"]
    return profiles.store_row(rows).select("s_suppkey", "brand", F.substring(stem, 3, 200).alias("webp"), manifests.slice_key(F.col("file"), n % 12).alias("slice"), text.shot_of(image, F.col("file")).alias("shot"), text.js_round(F.col("s_acctbal") - 0.5).alias("rounded"))


@query("SELECT c_custkey, substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21) AS uuid, md5(c_name) AS code, '10.0.0.' || c_custkey % 256 AS address, CASE WHEN c_custkey % 2 = 0 THEN 'a=1&b=2' ELSE 'a=2&c=1' END AS key, c_custkey % 3 <> 0 AS valid FROM customer")
def request_keys(spark, sf_dir):
    """UUID codes both ways and their check, addresses behind proxies, and queries in order."""
    n = F.col("c_custkey")
    uuid = text.uuid_decode(F.md5("c_name"))
    forwarded = F.concat(F.lit("1.2.3.4, 10.0.0."), (n % 256).cast("string"))
    valid = text.is_uuid(F.when(n % 3 == 0, F.md5("c_name")).otherwise(uuid))
    return table(spark, sf_dir, "customer").select("c_custkey", uuid.alias("uuid"), text.uuid_code(uuid).alias("code"), text.from_the_right(forwarded).alias("address"), text.sorted_query(F.when(n % 2 == 0, "b=2&a=1").otherwise("c=1&a=2")).alias("key"), valid.alias("valid"))


@query(
    "SELECT page_id, trim(regexp_replace(replace(replace(t, '&amp;', '&'), '&quot;', '\"'), '\\s+', ' ', 'g')) AS title, NULL::VARCHAR AS description, 'Shop ' || page_id AS decoded FROM (SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS t FROM pages)"
)
def page_facts(spark, sf_dir):
    """Title and description of pages, character references decoded."""
    html = F.col("html")
    odd = F.concat(F.lit("Shop&#32;"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", text.html_title(html).alias("title"), text.html_description(html).alias("description"), text.decoded(odd).alias("decoded"))


@query("WITH p AS (SELECT s_suppkey, s_nationkey, s_suppkey % 10 AS k FROM supplier) SELECT s_nationkey, 'brand' || min(k) AS brand FROM (SELECT s_nationkey, k, count(*) AS n, min(s_suppkey) AS f FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, min(s_suppkey)) = 1) GROUP BY 1")
def store_brands(spark, sf_dir):
    """The brand of a store by the most frequent last part of its titles."""
    title = F.concat(F.col("s_name"), F.lit(" | brand"), (F.col("s_suppkey") % 10).cast("string"))
    return profiles.brand_of(table(spark, sf_dir, "supplier").withColumn("title", title), "s_nationkey", "title", "s_suppkey")


COLOURS = {"red": "rgb(200, 10, 10)", "white": "#ffffff", "blue": "#1020e0"}


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 4 = 2")
def colour_filter(spark, sf_dir):
    """Blocks under a colour filter by bucket, and what has no colour left out."""
    css = F.when(F.col("p_partkey") % 4 == 0, COLOURS["red"]).when(F.col("p_partkey") % 4 == 1, COLOURS["white"]).when(F.col("p_partkey") % 4 == 2, COLOURS["blue"])
    facet = {"color": facets.Facet(colour.bucket(css))}
    return facets.where(table(spark, sf_dir, "part"), facet, facets.Filters({"color": ["red", "blue"]})).select("p_partkey")


@query("SELECT 'video' AS key, CASE WHEN p_size % 5 = 0 THEN 'yes' ELSE 'no' END AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT '#total', '', count(*) FROM part")
def video_facet(spark, sf_dir):
    """A count as a facet of yes and no."""
    videos = F.when(F.col("p_size") % 5 == 0, F.col("p_size") + 1).otherwise(0)
    return facets.facet_counts(table(spark, sf_dir, "part").withColumn("videos", videos), {"video": facets.yes_no(F.col("videos"))}, facets.Filters())


@query("SELECT 'q' AS key, count(*) AS n FROM part WHERE p_type = 'ECONOMY' AND NOT contains(lower(p_name), 'ring') HAVING count(*) > 0")
def near_miss_of_text(spark, sf_dir):
    """How many rows a query text alone keeps out."""
    named = facets.Facet(facets.yes_no_of(facets.contains_text([F.col("p_name")], "ring")))
    counts = facets.facet_counts(table(spark, sf_dir, "part"), {"type": facets.Facet(F.col("p_type")), "q": named}, facets.Filters({"type": ["ECONOMY"], "q": ["yes"]}))
    return facets.near_misses(counts).where("key = 'q'")


def _b64(x: str) -> str:
    return f"rtrim(translate(to_base64(unhex(sha256({x}))), '+/', '-_'), '=')"


@query(
    "SELECT s_suppkey, ['unknown', 'squarespace', 'wix', 'woocommerce', 'shopify'][s_suppkey % 5 + 1] AS family, CASE WHEN s_suppkey % 5 = 4 THEN 'shopify' ELSE 'other' END AS lane, 'mail:' || substr(" + _b64("lower(s_name)") + ", 1, 22) AS limit_key, sha256(s_name) AS token_hash, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 'shop/page' ELSE 'h u' END AS page_key, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 30 ELSE 0 END::INTEGER AS position FROM supplier"
)
def small_keys(spark, sf_dir):
    """Families, lanes, counter keys, token hashes and the parts of ids."""
    n = F.col("s_suppkey")
    named = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ("Squarespace-commerce", "wix-stores", "WordPress", "Shopify"))), (n % 5).cast("int"))
    block = F.when(n % 2 == 0, F.concat(F.lit("shop/page/desktop/"), (n % 30).cast("string"))).otherwise("a/b")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.platform_family(named).alias("family"), text.lane_for(named).alias("lane"), text.limit_key("mail", F.concat(F.lit(" "), F.upper("s_name"))).alias("limit_key"), text.token_hash(F.col("s_name")).alias("token_hash"),
        text.page_key(block, F.lit("h"), F.lit("u")).alias("page_key"), text.position_of(block).alias("position"),
    )


PROBED = "(SELECT page_id, html || ['', '<script src=\"//CDN.shopify.com\">', ' /static/version1/mage/ ', ' woocommerce Add to cart ', ' buy now Shop Now basket sold out'][page_id % 5 + 1] AS html FROM pages)"
PROBE_SQL = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(l, {_sql(m)})" for m in marks) + f" THEN {_sql(k)}" for marks, k in fixed.PROBE_PLATFORMS) + " END"


@query(
    f"WITH l AS (SELECT page_id, lower(html) AS l FROM {PROBED}), f AS (SELECT page_id, {PROBE_SQL} AS platform, {' + '.join(f'contains(l, {_sql(m)})::INTEGER' for m in fixed.PROBE_SIGNALS)} AS signals FROM l) SELECT *, coalesce(platform IN ({', '.join(map(_sql, fixed.PROBE_STORES))}), false) OR signals >= 3 AS store FROM f"
)
def page_probes(spark, sf_dir):
    """Platform, signals and verdict of a quick look at pages."""
    tails = ("", '<script src="//CDN.shopify.com">', " /static/version1/mage/ ", " woocommerce Add to cart ", " buy now Shop Now basket sold out")
    html = F.concat("html", F.get(F.array(*map(F.lit, tails)), (F.col("page_id") % 5).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", detect.probe(html).alias("p")).select("page_id", "p.platform", "p.signals", "p.store")


@query(
    "WITH s AS (SELECT o_orderkey, least(1.0, 1568.0 / greatest(o_custkey + 900, 2000)) AS k, o_custkey + 900 AS w FROM orders), t AS (SELECT o_orderkey, ceil(3001 / 3.0)::BIGINT + ceil((o_orderkey % 50) / 3.0)::BIGINT + ceil(greatest(floor(w * k + 0.5), 1) * greatest(floor(2000 * k + 0.5), 1) / 750)::BIGINT + 20 AS input_tokens, least(1024, 900 + o_orderkey % 300)::INTEGER AS output_tokens FROM s) "
    "SELECT o_orderkey, input_tokens, output_tokens, round((input_tokens * 2.0 + output_tokens * 10.0) * 0.5 / 1e6, 9) AS cost FROM t"
)
def request_estimates(spark, sf_dir):
    """Tokens and cost of requests before they are sent."""
    price = tags.price_of(F.lit("model-a"), [("^model", 2.0, 10.0)])
    n = F.col("o_orderkey")
    found = tags.estimate_request(F.lit(3001), n % 50, F.col("o_custkey") + 900, F.lit(2000), (900 + n % 300).cast("int"), price)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("e")).select("o_orderkey", "e.input_tokens", "e.output_tokens", F.round("e.cost", 9).alias("cost"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))")
def viewer_filters(spark, sf_dir):
    """Single values and a text over the index of blocks; what is not set filters nothing."""
    return facets.listed(table(spark, sf_dir, "part"), {"p_brand": "Brand#2", "p_type": None}, [F.col("p_name"), F.col("p_type")], " RING").select("p_partkey")


@query("SELECT 'type' AS key, p_type AS value, count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY 2")
def named_types(spark, sf_dir):
    """Types that name a kind of block, without parts."""
    kind = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit("-part"))).otherwise(F.col("p_type"))
    return facets.named_types(facets.facet_counts(table(spark, sf_dir, "part"), {"type": facets.Facet(kind)}, facets.Filters()), "type")


SITES = "SELECT s_suppkey, s_nationkey AS blocks, nullif(s_suppkey % 7, 0) AS rank, s_name AS brand FROM supplier"


@query(
    f"WITH s AS ({SITES}) SELECT 'az' AS sort, s_suppkey, row_number() OVER (ORDER BY brand) AS n FROM s QUALIFY n <= 30 UNION ALL SELECT 'traffic', s_suppkey, row_number() OVER (ORDER BY rank NULLS LAST, brand) AS n FROM s QUALIFY n <= 30 UNION ALL SELECT 'captured', s_suppkey, row_number() OVER (ORDER BY blocks DESC, rank NULLS LAST, brand) AS n FROM s QUALIFY n <= 30"
)
def site_sorts(spark, sf_dir):
    """The first sites by name, by traffic and by what is captured."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("blocks"), F.nullif(F.col("s_suppkey") % 7, F.lit(0)).alias("rank"), F.col("s_name").alias("brand"))
    parts = [paging.numbered(rows, paging.site_order(by), 30, 0).select(F.lit(by).alias("sort"), "s_suppkey", "n") for by in ("az", "traffic", "captured")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT p_partkey, sha256('stand-in' || chr(10) || p_type || ' block. ' || p_name) AS hash, 64 AS size FROM part WHERE p_partkey % 3 <> 0")
def embedding_job(spark, sf_dir):
    """Vectors of the rows whose text has changed; a third is on record."""
    rows = table(spark, sf_dir, "part")
    content = text.embedding_input(F.col("p_type"), F.col("p_name"), F.lit(""), F.lit(""))
    known = rows.where("p_partkey % 3 = 0").select("p_partkey", F.sha2(F.concat(F.lit("stand-in\n"), content), 256).alias("hash"))
    found = search.embed_changed(rows, ["p_partkey"], content, search.hashing_embedder(64), "stand-in", known)
    return found.select("p_partkey", "hash", F.size("embedding").alias("size"))
