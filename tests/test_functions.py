"""Expressions, row by row."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import colour, detect, tags, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_hosts(spark):
    assert values(spark, text.host_of, ["https://www.A.com/x", "b.co.uk/y?z", "ftp://a.com", "nohost", None, "http://"]) == ["a.com", "b.co.uk", None, None, None, None]
    assert values(spark, text.host_line, ["https://www.a.com/x # note", "# only", "", " B.org "]) == ["a.com", None, None, "b.org"]
    assert values(spark, text.suffixes, ["a.b.c.com", "c.com", "com"]) == [["a.b.c.com", "b.c.com", "c.com"], ["c.com"], ["com"]]


@pytest.mark.parametrize(
    ("url", "kind"),
    [("https://a.com", "home"), ("https://a.com/collections/x/products/y", "product"), ("https://a.com/gl/product/P1", "product"), ("https://a.com/dp/B00X", "product"), ("https://a.com/collections/", "collection-list"), ("https://a.com/shop/x/y", "collection"), ("https://a.com/checkout/cart", "cart"), ("https://a.com/checkout", "checkout"), ("https://a.com/blogs/news/post", "article"), ("https://a.com/blog", "blog"), ("https://a.com/en-us", "home"), ("https://a.com/pages/about", "page"), ("https://a.com/xyz", "other")],
)
def test_page_types(spark, url, kind):
    assert values(spark, text.page_type, [url]) == [kind]


def test_slugs(spark):
    import hashlib

    assert values(spark, text.page_slug, ["https://a.com/", "https://a.com/A_b/C?x=1", "https://a.com/" + "q" * 99]) == ["home", "a-b-c-" + hashlib.sha1(b"?x=1").hexdigest()[:6], "q" * 80]
    assert values(spark, text.slugify, ["Hello, World!", "--", ""]) == ["hello-world", "block", "block"]


def test_rounding_and_codes(spark):
    assert values(spark, text.js_round, [-2.5, 2.5, 2.4], "double") == [-2, 3, 2]
    assert values(spark, lambda c: text.uuid_decode(text.uuid_code(c)), ["0b0c5c1e-1d2f-4a6b-8c9d-001122334455"]) == ["0b0c5c1e-1d2f-4a6b-8c9d-001122334455"]
    assert values(spark, lambda c: text.from_the_right(c, 2), ["1.1.1.1, 2.2.2.2, 3.3.3.3", "9.9.9.9"]) == ["2.2.2.2", None]
    assert values(spark, lambda c: text.label(c, {"a": "A"}), ["a", "b", None]) == ["A", "b", None]


@pytest.mark.parametrize(("css", "name"), [("#fff", "white"), ("rgb(0, 0, 0)", "black"), ("rgba(255,0,0,.5)", "red"), ("#00ff00", "green"), ("#0000FF", "blue"), ("rgb(128 128 128)", "grey"), ("rgb(210,210,210)", "light"), ("#333333", "dark"), ("#ffa500", "orange"), ("transparent", None), ("", None), (None, None)])
def test_colours(spark, css, name):
    assert values(spark, colour.bucket, [css]) == [name]


def test_platforms(spark):
    shop = '<html lang="en-GB"><script>Shopify.theme = {"name":"N","schema_name":"Impact","schema_version":"5.2"};Shopify.currency = {"active":"GBP"};Shopify.country = "GB";</script>cdn.shopify.com pagefly'
    press = '<html lang="de"><link href="/wp-content/themes/astra/x.css"> elementor "priceCurrency": "EUR"'
    got = values(spark, detect.fingerprint, [shop, press, "nothing", None])
    assert got[0].asDict() == {"platform": "shopify", "builder": "pagefly", "theme": "Impact", "theme_version": "5.2", "currency": "GBP", "country": "GB", "locale": "en-GB"}
    assert (got[1]["platform"], got[1]["builder"], got[1]["theme"], got[1]["currency"], got[1]["locale"]) == ("wordpress", "elementor", "astra", "EUR", "de")
    assert got[2]["platform"] is None and got[3]["platform"] is None
    assert values(spark, detect.apps, ["x KLAVIYO y paypal.com", "none"]) == [["Klaviyo", "PayPal"], []]


def test_store_verdict(spark):
    rows = [("shopify", 1, 0, "T", [], True), ("shopify", 0, 1, "T", [], False), (None, 2, 0, "T", [], True), (None, 1, 2, "T", [], True), (None, 0, 4, "T", [], True), (None, 0, 1, "Official Online Store", [], True), (None, 0, 0, "T", ["gallery"], False), (None, 1, 0, "T", ["gallery"], True), ("shopify", 9, 9, "judi casino", [], False)]
    df = spark.createDataFrame(rows, "platform string, strong int, weak int, title string, sources array<string>, want boolean")
    got = df.select(detect.looks_like_store(F.col("platform"), F.col("strong"), F.col("weak"), F.col("title"), F.lit(None).cast("string"), F.col("sources")).alias("ok"), "want").collect()
    assert [r["ok"] for r in got] == [r["want"] for r in got]


def test_parked_walls_and_failures(spark):
    assert values(spark, detect.parked, ["This domain is FOR SALE", "coming soon" + "x" * 20_000, "coming soon", "fine"]) == ["this domain is for sale", None, "coming soon", None]
    assert values(spark, lambda c: detect.wall(F.lit(""), c), ["Just a  moment...", "Access to this page has been denied", "please select your country", "x" * 1501 + " just a moment", "welcome"]) == ["human-check", "access-denied", "location-gate", None, None]
    assert values(spark, detect.failure_kind, ["dead", "page-timeout", "Target closed", "http-404", None]) == ["transient", "transient", "browser", "final", None]


def test_countries(spark):
    df = spark.createDataFrame([("a.co.uk", None, None, None, "GB"), ("a.com", "SEK", None, None, "SE"), ("a.com", None, "en-ca", None, "CA"), ("a.com", None, None, "XK", None), ("a.com", None, "en", "US", "US")], "h string, cur string, loc string, vis string, want string")
    got = df.select(detect.country(F.col("h"), F.col("cur"), F.col("loc"), F.col("vis")).alias("c"), "want").collect()
    assert [r["c"] for r in got] == [r["want"] for r in got]


def test_industry(spark):
    words = {"pets": ["dog", "cat"], "food": ["tea", "olive oil"]}
    got = values(spark, lambda c: detect.industry([(c, 1.0)], words), ["dog, dog. dog", "tea olive oil, dog cat tea", "dog " * 40, "none", None])
    assert [(r["industry"], r["score"], r["runner_up"]) for r in got] == [("pets", 3.0, None), ("food", 3.0, "pets"), ("pets", 12.0, None), ("other", 0.0, None), ("other", 0.0, None)]


def test_tag_errors(spark):
    tax = {"block_type": ["hero"], "page_role": ["home"], "industry": ["pets"], "style_tags": ["bold", "calm"]}
    good = {"block_type": "hero", "page_role": "home", "style_tags": ["bold"], "industry": "pets", "description": "A hero.", "patterns": [], "has_price": False, "has_reviews": True, "has_video": False}
    rows = [good, good | {"block_type": "x"}, good | {"style_tags": ["bold", "bold"]}, good | {"description": "a\nb"}, good | {"more": 1}, {k: v for k, v in good.items() if k != "industry"}, good | {"has_price": "maybe"}]
    got = values(spark, lambda c: tags.tag_errors(c, tax), [*map(json.dumps, rows), "nonsense"])
    assert got[0] == []
    assert got[1:] == [["block_type is not in the taxonomy"], ["style_tags repeats a tag"], ["description is more than one line"], ["unexpected field more"], ["missing industry"], ["has_price is not a boolean"], ["not an object"]]


def test_costs(spark):
    price = tags.price_of(F.lit("m-1"), [("^m", 2.0, 10.0)])
    cost = tags.batch_cost(F.lit(1_000_000), F.lit(100_000), F.lit(None).cast("int"), F.lit(1_000_000), price)
    assert spark.range(1).select(cost).first()[0] == pytest.approx(1.0 + 0.5 + 0.1)
    assert spark.range(1).select(tags.price_of(F.lit("q"), [("^m", 2.0, 10.0)])).first()[0] is None
    assert tuple(spark.range(1).select(tags.sent_size(F.lit(3136), F.lit(100))).first()[0]) == (1568, 50)


def test_briefs(spark):
    df = spark.createDataFrame([("faq-list", "  Hi\n there ", "x" * 700, 2, 0), ("hero", None, "", 0, 0)], "k string, h string, b string, buttons int, videos int")
    got = [r[0] for r in df.select(text.brief(F.col("k"), {"buttons": F.col("buttons"), "videos": F.col("videos")}, F.col("h"), F.col("b"))).collect()]
    assert got == ["A faq list block.\nHeadline: Hi there\nCopy: " + "x" * 600 + "\nIt has 2 buttons.", "A hero block."]
