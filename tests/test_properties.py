"""Properties that hold whatever the data: facets, near misses, paging, replays, orders."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import dedup, facets, joins, layout, paging, ranking, search, state, versions

def all_facets():
    return {"kind": facets.Facet(F.col("kind")), "host": facets.Facet(F.col("host")), "app": facets.Facet(F.col("apps"), is_array=True)}


@pytest.fixture(scope="module")
def wall(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hero", "faq", None]), rng.choice("abc"), rng.choice([["x"], ["x", "y"], [], None, ["y", None]])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, kind string, host string, apps array<string>").cache()


def counts(df, wanted, extra=None):
    return {(r["key"], r["value"]): r["n"] for r in facets.facet_counts(df, all_facets(), facets.Filters(wanted), extra).collect()}


def test_facet_ignores_its_own_filter(wall):
    wanted = {"kind": ["hero"], "app": ["y"]}
    got = counts(wall, wanted)
    for key in all_facets():
        others = counts(wall, {k: v for k, v in wanted.items() if k != key})
        assert {v: n for (k, v), n in got.items() if k == key} == {v: n for (k, v), n in others.items() if k == key}


def test_near_miss_is_what_dropping_a_filter_adds(wall):
    wanted = {"kind": ["hero"], "host": ["a", "b"], "app": ["y"]}
    got = counts(wall, wanted)
    total = facets.where(wall, all_facets(), facets.Filters(wanted)).count()
    assert got.get(("#total", ""), 0) == total
    for key in wanted:
        more = facets.where(wall, all_facets(), facets.Filters(wanted), skip=(key,)).count()
        assert got.get(("#near", key), 0) == more - total


def test_condition_without_facet_takes_part(wall):
    got = counts(wall, {"kind": ["hero"]}, {"q": F.col("id") < 100})
    hero = wall.where("kind = 'hero'")
    assert got["#total", ""] == hero.where("id < 100").count()
    assert got["#near", "q"] == hero.where("id >= 100").count()


def test_multi_select_widens(wall):
    one = facets.where(wall, all_facets(), facets.Filters({"host": ["a"]})).count()
    assert facets.where(wall, all_facets(), facets.Filters({"host": ["a", "b"]})).count() >= one


def test_filters_are_read():
    read = facets.Filters.read({"host": " a, ,b", "kind": " , ", "q": "x"}, ("host", "kind"))
    assert read.wanted == {"host": ["a", "b"]}
    assert facets.Filters({"host": ["a"], "theme": ["t"]}).allowed().wanted == {"host": ["a"]}


def test_pages_cover_each_row_once(wall):
    order = [F.asc_nulls_last("kind"), F.asc("id")]
    seen, at = [], 0
    while at is not None:
        page = [r["id"] for r in paging.page(wall, order, 70, at).collect()]
        seen += page
        at = paging.next_cursor(at, len(page), 300)
    assert sorted(seen) == list(range(300))
    assert paging.clamp(None, None) == (60, 0) and paging.clamp("0", "-3") == (60, 0) and paging.clamp(-5, 2) == (1, 2) and paging.clamp(999, "x") == (200, 0)


def test_replayed_upserts_change_nothing(spark):
    rows = [(1, 1, "a", ["x"]), (1, 2, None, ["y"]), (2, 3, "c", None)]
    df = spark.createDataFrame(rows, "k int, seq int, v string, apps array<string>")
    for op in (lambda d: versions.upsert_last_wins(d, ["k"], "seq"), lambda d: versions.upsert_first_wins(d, ["k"], "seq"), lambda d: versions.upsert_merge(d, ["k"], "seq", last=["v"], union=["apps"])):
        assert sorted(map(str, op(df).collect())) == sorted(map(str, op(df.union(df)).collect()))
    assert {r["k"]: (r["v"], r["apps"]) for r in versions.upsert_merge(df, ["k"], "seq", last=["v"], union=["apps"]).collect()} == {1: ("a", ["x", "y"]), 2: ("c", [])}


def test_arrival_order_does_not_matter(spark):
    rows = [(k, t, f"{k}-{t}") for k in range(5) for t in range(6)]
    random.Random(2).shuffle(rows)
    a = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq int, k int, at int, v string")
    b = spark.createDataFrame([(i, *r) for i, r in enumerate(reversed(rows))], "seq int, k int, at int, v string")
    final = lambda d: sorted((r["k"], r["v"]) for r in versions.event_time_apply(d, ["k"], "at", "seq").collect())
    assert final(a) == final(b) == [(k, f"{k}-5") for k in range(5)]


def test_dedup_comes_before_filters(spark):
    rows = [("h", "d", "home", "hero-part", None, "/a", 1, "1"), ("h", "d", "home", "hero", None, "/b", 2, "2"), ("h", "d", "other", None, "hero", "/0", 0, "3"), ("h", "m", "other", "hero", None, "/0", 0, "4")]
    df = spark.createDataFrame(rows, "host string, viewport string, page_type string, block_type string, type_hint string, url string, block_index int, id string")
    assert sorted(r["id"] for r in dedup.shown_per_section(df).collect()) == ["2", "4"]
    free = dedup.shown_in_order(df.withColumn("seq", F.col("block_index")), "seq", F.col("id") == "3")
    assert [r["id"] for r in free.collect()][-1] == "2" and free.count() == 3


def test_asof_and_previous(spark):
    a = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, at int")
    b = spark.createDataFrame([(1, 5, "x"), (1, 9, "y")], "k int, at int, v string")
    assert sorted((r["k"], r["at"], r["asof_v"]) for r in versions.asof_join(a, b, ["k"], "at", ["v"]).collect()) == [(1, 5, "x"), (1, 10, "y"), (2, 1, None)]
    assert sorted((r["k"], r["at"], r["asof_v"]) for r in versions.asof_join(a, b, ["k"], "at", ["v"], strict=True).collect() if r["k"] == 1) == [(1, 5, None), (1, 10, "y")]


def test_diff_is_null_safe(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, None), (4, "b")], "k int, v string")
    assert {r["k"]: r["change"] for r in versions.snapshot_diff(old, new, ["k"], ["v"]).collect()} == {2: "changed", 3: "removed", 4: "added"}


def test_suffix_lookups(spark):
    hosts = spark.createDataFrame([("shop.a.com",), ("b.org",), ("localhost",), ("x.bad.com",)], "host string")
    ranks = spark.createDataFrame([("a.com", 7), ("shop.a.com", 3)], "domain string, rank int")
    assert {r["host"]: r["rank"] for r in joins.longest_suffix(hosts, "host", ranks, "domain", "rank").collect()} == {"shop.a.com": 3, "b.org": None, "localhost": None, "x.bad.com": None}
    listed = spark.createDataFrame([("bad.com",)], "d string")
    assert sorted(r["host"] for r in joins.without_listed(hosts, "host", listed, "d", (".org",)).collect()) == ["shop.a.com"]


def test_first_alternative(spark):
    events = spark.createDataFrame([(1, "u1", "s9"), (2, None, "s2"), (3, None, None)], "e int, user string, sub string")
    users = spark.createDataFrame([("u1", "s1"), ("u2", "s2"), ("u3", "s9")], "id string, subscription string")
    got = joins.first_alternative(events, "e", users, [("user", "id"), ("sub", "subscription")], "id")
    assert {r["e"]: r["id"] for r in got.collect()} == {1: "u1", 2: "u2"}


def test_similar_terms_equal_all_pairs(spark):
    words = ["nation", "notion", "ration", "cat", "cart", "art"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    grams = lambda w: {("  " + w + " ")[i : i + 3] for i in range(len(w) + 1)}
    want = {(a, b): len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in words for b in words if a != b}
    got = {(r["word"], r["term"]): r["similarity"] for r in joins.similar_terms(df, "w", df, "w").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v >= 0.3}


def test_quotas():
    assert ranking.quotas({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert sum(ranking.quotas({str(i): i for i in range(1, 30)}, 100).values()) == 100
    assert ranking.quotas({"a": 2}, 10) == {"a": 2}
    assert ranking.quotas({}, 10) == {}


def test_capped_prefix_at_the_boundary(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 6.0), (3, 0.0), (4, 0.1)], "i int, cost double")
    got = ranking.capped_prefix(df, [F.asc("i")], "cost", 5.0, 15.0).orderBy("i").collect()
    assert [r["accepted"] for r in got] == [True, True, True, False]


def test_packing_keeps_rows_within_the_wall(spark):
    wall = layout.synthetic(spark, 400).withColumn("width", (F.col("height") / 8).cast("int")).withColumn("one", F.lit(1))
    got = layout.wall_pack(wall, "one", "id", "width", 300, 5).collect()
    by_row = {}
    for r in got:
        by_row.setdefault(r["row"], []).append((r["x"], r["width"]))
    assert len(got) == 400 and sorted(by_row) == list(range(len(by_row)))
    for frames in by_row.values():
        frames.sort()
        assert all(x + w + 5 == y for (x, w), (y, _) in zip(frames, frames[1:], strict=False)) and frames[-1][0] + frames[-1][1] <= 300


def test_cut_blocks(spark):
    df = spark.createDataFrame([("p", 0, 0.5), ("p", 1, 0.49), ("p", 2, 0.3), ("p", 3, 0.2)], "p string, i int, r double")
    got = [(r["i"], round(r["shown"], 2)) for r in layout.cut_blocks(df, ["p"], ["i"], "r", 1.0).orderBy("i").collect()]
    assert got == [(0, 0.5), (1, 0.49)]


def test_search_degrades_to_text(spark):
    docs = spark.createDataFrame([(1, "Subscribe & save 15%", [1.0, 0.0]), (2, "plain text", [0.0, 1.0]), (3, "subscribe here", None)], "id long, text string, v array<double>")
    run = lambda **k: [tuple(r) for r in search.search(docs, "id", {"C": "text"}, "subscription picker", **k).collect()]

    def broken(q):
        raise TimeoutError

    assert run() == run(vector="v", embedder=broken) == run()
    assert {r[0] for r in run()} == {1, 3}
    assert len(run(vector="v", embedder=lambda q: [0.0, 1.0])) == 3
    assert search.search(docs, "id", {"C": "text"}, "the").count() == 0


def test_query_reading():
    assert search.query_words("Crème BRÛLÉE don't crème 1st") == ["creme", "brulee", "don't", "1st"]
    assert search.intents(["product", "reviews"]) == {"product-reviews": ["product", "reviews"]}
    assert search.intents(["subscripton", "picker"]) == {"subscription-picker": ["subscripton", "picker"]}
    assert search.same_word("menus", "menu") and search.same_word("newsleter", "newsletter") and not search.same_word("cat", "car")


@pytest.mark.parametrize("seed", range(3))
def test_edit_distance_within(seed):
    rng = random.Random(seed)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in range(2))
        for most in (1, 2):
            assert search.within_edits(a, b, most) == (full(a, b) <= most)


def test_state_rules(spark):
    hits = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 1, 2, 61])], "seq int, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = state.rate_limit(hits, "key", "ts", "seq", 60, 2).orderBy("seq").collect()
    assert [(r["allowed"], r["retry_after"]) for r in got] == [(True, None), (True, None), (False, 58), (True, None)]
    views = spark.createDataFrame([(0, "v", "a"), (1, "v", "b"), (2, "v", "c"), (3, "v", "a")], "seq int, viewer string, item string").withColumn("ts", F.timestamp_seconds(F.lit(5)))
    assert [r["allowed"] for r in state.daily_cap(views, "viewer", "ts", "item", "seq", 2).orderBy("seq").collect()] == [True, True, False, True]
    slots = spark.createDataFrame([("h", 0.0, None), ("h", 0.5, 20.0), ("h", 30.0, 2.0)], "host string, ready double, delay double")
    assert [r["start"] for r in state.pacing(slots, "host", "ready", "delay").orderBy("ready").collect()] == [0.0, 1.0, 30.0]
    codes = spark.createDataFrame([("s", i, 1, False) for i in range(5)] + [("s", 5, 9, True), ("t", 0, 4, True), ("t", 1, 4, True)], "s string, seq int, step int, ok boolean")
    assert [r["outcome"] for r in state.two_step(codes, "s", "seq", "step", "ok").orderBy("s", "seq").collect()] == ["wrong"] * 5 + ["ended", "ok", "wrong"]


def test_subscription_events(spark):
    rows = [("e1", 1, "u", "s1", "active", "p", 2, 10, True), ("e1", 2, "u", "s1", "active", "p", 2, 10, True), ("e2", 3, "u", "s1", "active", "p", 2, 5, True), ("e3", 4, "u", "s2", "canceled", "p", 2, 20, True), ("e4", 5, "u", "s1", "active", "zzz", 2, 20, True), ("e5", 6, None, "s1", "active", "p", 2, 20, True), ("e6", 7, "u", "s1", "active", "p", 2, 20, False), ("e7", 8, "u", "s1", "canceled", "p", 2, 10, True)]
    df = spark.createDataFrame(rows, "event_id string, arrival long, user_id string, subscription string, status string, price string, quantity int, occurred_at long, relevant boolean")
    got = [(r["outcome"], r["seats"]) for r in state.subscription_outcomes(df, plans={"p": "team"}).orderBy("arrival").collect()]
    assert got == [("applied:team", 2), ("duplicate", None), ("stale", None), ("other_subscription", None), ("unknown_price", None), ("unmatched", None), ("ignored", None), ("applied:free", None)]
