"""Files in, files out, and the streaming twins."""

import json

import pytest
from pyspark.sql import functions as F

from quern import schemas
from quern.functions import crypto
from quern.operators import mutations, profiles, state, trees
from quern.sources import commits, files, manifests, upserts
from quern.streaming import operators as streams


def document(host="a.com", url="https://a.com/", at="2026-01-01T00:00:00Z", blocks=(), **site):
    view = {"file": "d.png", "width": 1200, "fullHeight": 3000}
    return {"site": {"host": host, "apps": ["x"], "theme": {"name": "T"}, **site}, "page": {"url": url, "type": "home", "capturedAt": at, "title": "Hi\u0000!"}, "viewports": {"desktop": view, "mobile": {"error": "timeout"}}, "blocks": list(blocks)}


@pytest.fixture()
def folder(tmp_path):
    block = {"index": 0, "typeHint": "hero", "viewport": "desktop", "top": 0.5, "height": 99.5, "width": 10, "text": "a\u0000b", "headline": "", "file": "b.png"}
    docs = {"a": document(blocks=[block, block | {"index": 1, "file": None}]), "b": document(at="2026-02-01T00:00:00Z", blocks=[block | {"height": 120}], apps=["y"], platform="shopify"), "c": document("b.com", "https://www.other.com/de/x", blocks=[])}
    for name, doc in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(doc))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest.json").write_text("{ not json")
    (tmp_path / "a" / "images.json").write_text(json.dumps({"images": {"b.png": {"width": 5, "height": 6}}}))
    return str(tmp_path)


def test_manifests(spark, folder):
    good, bad = manifests.read_manifests(spark, folder)
    assert good.count() == 3 and bad.count() == 1
    sites = {r["host"]: r for r in manifests.site_rows(good).collect()}
    assert sites["a.com"]["apps"] == ["x", "y"] and sites["a.com"]["platform"] == "shopify" and sites["a.com"]["theme"] == "T" and sites["a.com"]["title"] == "Hi!"
    captures, blocks, pages = manifests.capture_rows(good), manifests.block_rows(good), manifests.page_rows(good)
    assert captures.count() == 3 and pages.count() == 2
    assert manifests.capture_rows(good.union(good)).count() == 3 and manifests.block_rows(good.union(good)).count() == blocks.count() == 3
    first = blocks.where("block_index = 0").orderBy("height").first()
    assert (first["top"], first["height"], first["text"], first["headline"]) == (1, 100, "ab", None)
    odd = {(r["host"], r["url"]): r for r in manifests.edge_cases(good).collect()}
    assert odd["b.com", "https://www.other.com/de/x"]["redirected_host"] and odd["b.com", "https://www.other.com/de/x"]["no_blocks"] and odd["a.com", "https://a.com/"]["viewport_failed"]
    assert manifests.sample_items(good).count() == 2
    assert manifests.api_items(blocks, captures, pages, manifests.site_rows(good)).count() == 3
    side = manifests.read_sidecars(spark, folder)
    rows = good.select("folder", F.explode("blocks").alias("b")).select("folder", F.col("b.file").alias("file"))
    assert sum(r["image"] is not None for r in manifests.with_images(rows, side, "folder", "file").collect()) == 1
    assert json.loads(manifests.index_document(good).where("host = 'a.com'").first()["document"])["pages"][0]["url"] == "https://a.com/"
    latest = profiles.latest_pages(pages, captures, blocks).where("host = 'a.com'").first()["pages"]
    assert [(p["page_type"], p["blocks"]) for p in latest] == [("home", 1)]


def test_schema_guard(spark):
    df = spark.createDataFrame([("a", 1)], "term string, docs bigint")
    assert schemas.assert_schema(df, schemas.TERMS) is df
    with pytest.raises(TypeError):
        schemas.assert_schema(df.withColumn("docs", F.col("docs").cast("string")), schemas.TERMS)


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('host,brand,apps\r\na.com,"He said ""hi"", ok",x|y\r\n,,\r\nb.com,"two\nlines"\r\n')
    rows = files.read_csv(spark, str(path), ("host", "brand", "apps"))
    got = {r["host"]: r for r in rows.collect()}
    assert set(got) == {"a.com", "b.com"} and got["a.com"]["brand"] == 'He said "hi", ok' and got["b.com"]["apps"] == "" and "\n" in got["b.com"]["brand"]
    files.write_csv(rows, str(tmp_path / "out"))
    assert sorted(map(str, files.read_csv(spark, str(tmp_path / "out"), ("host", "brand", "apps")).collect())) == sorted(map(str, rows.collect()))
    assert {r["host"]: r["apps"] for r in files.typed_seeds(rows).collect()} == {"a.com": ["x", "y"], "b.com": []}


def test_text_lists_and_links(spark, tmp_path):
    (tmp_path / "h.txt").write_text("# c\nhttps://www.A.com/x\n\nb.org # y\n")
    assert sorted(r["host"] for r in files.read_hosts(spark, str(tmp_path / "h.txt")).collect()) == ["a.com", "b.org"]
    (tmp_path / "r.txt").write_text("a.com not a store\nb.com\n")
    assert {r["host"]: r["reason"] for r in files.read_host_reasons(spark, str(tmp_path / "r.txt")).collect()} == {"a.com": "not a store", "b.com": None}
    import zipfile

    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("top.csv", "1,a.com\n2,b.com\n")
    assert {r["host"]: r["rank"] for r in files.read_ranks(spark, str(tmp_path / "t.zip")).collect()} == {"a.com": 1, "b.com": 2}
    xml = spark.createDataFrame([("<loc> https://a.com/p </loc><loc>https://a.com/q</loc><loc>https://a.com/p</loc>",)], "x string")
    assert sorted(r["url"] for r in files.sitemap_urls(xml, "x", "/p").collect()) == ["https://a.com/p"]
    board = spark.createDataFrame([("b?é", 3)], "name string, n int")
    back = board.select(files.read_snapshot_link(files.snapshot_link(F.struct("name", "n")), "name string, n int").alias("b")).select("b.*")
    assert back.collect() == board.collect()
    assert [tuple(r) for r in files.zipped(spark, a=[1, 2], b=["x", "y"]).collect()] == [(0, 1, "x"), (1, 2, "y")]


def test_queue_and_boards(spark):
    events = [("a", 1, "enqueue", None), ("a", 2, "claim", None), ("a", 3, "fail", "r1"), ("a", 4, "claim", None), ("a", 5, "fail", "r2"), ("b", 1, "enqueue", None), ("b", 2, "claim", None), ("b", 3, "finish", None), ("c", 1, "claim", None), ("c", 2, "reset", None), ("d", 1, "claim", None), ("d", 2, "fail", "x"), ("d", 3, "claim", None), ("d", 4, "fail", "y"), ("d", 5, "requeue", None)]
    df = spark.createDataFrame(events, "k string, seq int, kind string, reason string")
    got = {r["k"]: (r["status"], r["attempts"], r["reason"]) for r in mutations.queue_state(df, "k", "seq", "kind", "reason", 2).collect()}
    assert got == {"a": ("failed", 2, "r2"), "b": ("done", 1, None), "c": ("pending", 1, None), "d": ("pending", 0, "y")}
    log = [("B", "x", 1, "add", None), ("B", "x", 2, "note", "one"), ("B", "x", 3, "note", "two" * 900), ("B", "y", 4, "add", None), ("B", "y", 5, "remove", None)]
    items = mutations.board_items(spark.createDataFrame(log, "board_id string, block_id string, seq int, kind string, note string")).collect()
    assert [(r["block_id"], len(r["note"])) for r in items] == [("x", 2000)]


@pytest.fixture()
def event_files(spark, tmp_path):
    rows = [(i, f"u{i % 3}", "abcd"[i % 4], 864_000 + i * 600) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, viewer string, item string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, str(tmp_path)


def test_stream_equals_batch(spark, event_files):
    streams.use_rocksdb(spark)
    df, path = event_files
    read = lambda: streams.events_stream(spark, f"{path}/in", df.schema)
    hits = streams.run_once(streams.window_hits(read(), "viewer", "ts", "1 hour"), "hits", "complete", f"{path}/c1").collect()
    batch = state.rate_limit(df, "viewer", "ts", "seq", 3600, 99).groupBy("viewer", "window_start").agg(F.max("hits").alias("hits")).collect()
    assert sorted(map(tuple, hits)) == sorted(map(tuple, batch))
    got = streams.run_once(streams.daily_cap(read(), "viewer", "ts", "item", "seq", 2), "cap", "append", f"{path}/c2").collect()
    want = state.daily_cap(df, "viewer", "ts", "item", "seq", 2).collect()
    assert sorted((r["seq"], r["allowed"]) for r in got) == sorted((r["seq"], r["allowed"]) for r in want)
    twice = streams.run_once(streams.once(read().union(read()), "seq", "ts"), "once", "append", f"{path}/c3")
    assert twice.count() == 40
    streams.upsert_latest(read(), ["viewer"], "seq", f"{path}/table", f"{path}/c4").awaitTermination()
    assert sorted(r["seq"] for r in upserts.read(spark, f"{path}/table").collect()) == [37, 38, 39]


def test_subscription_stream(spark, tmp_path):
    streams.use_rocksdb(spark)
    rows = [("e1", 1, "u", "s1", "active", "p", 2, 10), ("e2", 2, "u", "s1", "active", "p", 2, 5), ("e3", 3, "u", "s2", "canceled", "p", 2, 20), ("e4", 4, "u", "s1", "canceled", "p", 2, 30), ("f1", 5, "v", "s5", "active", "q", 1, 1)]
    df = spark.createDataFrame(rows, "event_id string, arrival long, user_id string, subscription string, status string, price string, quantity int, occurred_at long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = streams.run_once(streams.subscription_outcomes(stream, {"p": "pro"}), "subs", "append", str(tmp_path / "c")).collect()
    want = state.subscription_outcomes(df.withColumn("relevant", F.lit(True)), plans={"p": "pro"}).collect()
    assert sorted((r["event_id"], r["outcome"]) for r in got) == sorted((r["event_id"], r["outcome"]) for r in want)


def test_refresh_view_swaps_whole_tables(spark, tmp_path):
    path = str(tmp_path / "terms")
    assert mutations.refresh_view(spark.range(5), path).count() == 5
    assert mutations.refresh_view(spark.range(10, 13), path).count() == 3
    # a table may be refreshed from its own rows
    assert mutations.refresh_view(commits.read(spark, path).where("id > 10"), path).count() == 2
    assert sorted(r["id"] for r in commits.read(spark, path).collect()) == [11, 12]
    assert sorted(p.name[:2] for p in tmp_path.joinpath("terms").iterdir()) == ["_c", "v-", "v-"]


def test_import_with_quarantine(spark, folder, tmp_path):
    good, bad = manifests.read_manifests(spark, folder)
    root = str(tmp_path / "store")
    first = manifests.import_manifests(good, bad, root)
    assert commits.read(spark, root, "quarantine").count() == 1 and commits.read(spark, root, "pages").count() == 2
    texts = spark.createDataFrame([(1, json.dumps(document("z.com"))), (2, "{ not"), (3, "{}"), (4, None), (5, "[1]")], "id int, doc string")
    good, bad = manifests.parse_manifests(texts, "doc")
    assert sorted(r["id"] for r in good.collect()) == [1] and sorted((r["id"], r["doc"]) for r in bad.collect() if r["doc"]) == [(2, "{ not"), (3, "{}"), (5, "[1]")] and bad.count() == 4
    manifests.import_manifests(good.withColumn("folder", F.lit("f")), bad, root)
    assert commits.current(spark, root).number == first.number + 1
    assert [r["host"] for r in commits.read(spark, root, "sites").collect()] == ["z.com"]


def test_upserts_write_the_buckets_they_touch(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    rows = lambda: {r["k"]: r["v"] for r in upserts.read(spark, root).collect()}
    first = upserts.upsert(root, frame([(k, 1, f"a{k}") for k in range(40)]), ["k"], "at", 0, buckets=8, deltas=2)
    assert set(first.properties["files"]) == set(map(str, range(8)))
    second = upserts.upsert(root, frame([(3, 2, "b3"), (3, 2, "b9"), (5, 0, "late")]), ["k"], "at", 1, deltas=2)
    touched = {b for b, f in second.properties["files"].items() if len(f) > 1}
    assert len(touched) <= 2 and all(second.properties["files"][b][:1] == f for b, f in first.properties["files"].items())
    assert rows() == {k: f"a{k}" for k in range(40)} | {3: "b9"}
    # a batch that runs again changes nothing
    assert upserts.upsert(root, frame([(3, 99, "twice")]), ["k"], "at", 1) == second and rows()[3] == "b9"
    third = upserts.upsert(root, frame([(3, 2, "tie"), (41, 1, "new")]), ["k"], "at", 2, deltas=2)
    bucket = next(b for b in touched if len(second.properties["files"][b]) == 2 and third.properties["files"][b] != second.properties["files"][b])
    assert len(third.properties["files"][bucket]) == 1 and rows()[3] == "tie" and rows()[41] == "new"
    quiet = [b for b, f in third.properties["files"].items() if f == first.properties["files"][b]]
    assert len(quiet) >= 5  # never written again
    for n in range(3, 7):
        upserts.upsert(root, frame([(3, n, f"n{n}")]), ["k"], "at", n, deltas=2, keep=2)
    assert rows()[3] == "n6" and len(rows()) == 41
    old = first.properties["files"][bucket][0]
    assert not (tmp_path / "t" / old.rsplit("/", 1)[1] / f"__bucket={bucket}").exists() and len(list((tmp_path / "t" / "_commits").glob("0*.json"))) == 2
    with pytest.raises(ValueError):
        upserts.upsert(root, frame([]), ["v"], "at")


def test_feed_ends_at_a_short_page(spark):
    pages = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [3]), ("a", 3, [4, 5]), ("b", 1, [6, 7]), ("b", 3, [8]), ("c", 2, [9]), ("d", 1, [])], "f string, n int, items array<int>")
    got = sorted((r["f"], r["n"], r["item"]) for r in files.feed_items(pages, "f", "n", "items", 2).collect())
    assert got == [("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("b", 1, 6), ("b", 1, 7)]


def test_descent_ends_on_a_cycle(spark):
    boxes = [(1, None, 100.0, 0), (2, 1, 90.0, 0), (3, 2, 50.0, 0), (4, 2, 40.0, 1), (5, 3, 30.0, 0), (6, 3, 5.0, 1), (7, 4, 39.0, 0), (20, None, 9.0, 0), (30, None, 50.0, 0), (31, 30, 10.0, 0), (32, 30, 5.0, 1)]
    df = spark.createDataFrame(boxes, "id int, parent int, height double, seq int")
    cut = lambda d, h, b: sorted((r["root"], r["id"], r["splits"], r["hops"]) for r in trees.refine(d, h, b).collect())
    assert cut(df, 45, 5) == [(1, 4, 1, 2), (1, 5, 2, 3), (1, 6, 2, 3), (20, 20, 0, 0), (30, 30, 0, 0)]
    assert cut(df, 45, 1)[:2] == [(1, 3, 1, 2), (1, 4, 1, 2)]
    loop = spark.createDataFrame([(1, None, 100.0, 0), (2, 1, 90.0, 0), (3, 2, 90.0, 0), (2, 3, 90.0, 0)], "id int, parent int, height double, seq int")
    assert {r[3] for r in cut(loop, 1, 5)} == {14}


def test_keyed_hashes(spark):
    # RFC 4231, cases 1, 2, 6; RFC 6238, appendix B
    key = lambda h: F.unhex(F.lit(h))
    row = spark.range(1).select(
        F.lower(F.hex(crypto.hmac(key("0b" * 20), crypto.utf8(F.lit("Hi There"))))).alias("a"),
        F.lower(F.hex(crypto.hmac(crypto.utf8(F.lit("Jefe")), crypto.utf8(F.lit("what do ya want for nothing?"))))).alias("b"),
        F.lower(F.hex(crypto.hmac(key("aa" * 131), crypto.utf8(F.lit("Test Using Larger Than Block-Size Key - Hash Key First"))))).alias("c"),
        *[crypto.time_code(crypto.utf8(F.lit("12345678901234567890")), F.lit(t), 8).alias(f"t{t}") for t in (59, 1111111109, 20000000000)],
        crypto.time_code(crypto.utf8(F.lit("12345678901234567890123456789012")), F.lit(59), 8, kind="sha256").alias("s"),
        *[crypto.time_code_valid(crypto.utf8(F.lit("12345678901234567890")), F.lit("287082"), F.lit(t)).alias(f"v{t}") for t in (59, 29, 89, 120)],
    ).first()
    assert row["a"] == "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"
    assert row["b"] == "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"
    assert row["c"] == "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"
    assert (row["t59"], row["t1111111109"], row["t20000000000"], row["s"]) == ("94287082", "07081804", "65353130", "46119246")
    assert [row[f"v{t}"] for t in (59, 29, 89, 120)] == [True, True, True, False]


def test_signed_messages(spark):
    import hashlib
    import hmac

    mac = lambda ts, body: hmac.new(b"key", f"{ts}:{body}".encode(), hashlib.sha256).hexdigest()
    cases = [(f"ts=1000;h1={mac(1000, 'é')}", "é", True), (f"h1=00; h1={mac(1000, 'x').upper()} ;ts=1000", "x", True), (f"ts=1000;h1={mac(1000, 'x')}", "y", False), (f"ts=10;h1={mac(10, 'x')}", "x", False), ("ts=1000", "x", False), (None, "x", False), (f"ts=a;h1={mac('a', 'x')}", "x", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "h string, b string")
    got = df.select(crypto.signed(F.col("h"), F.col("b"), crypto.utf8(F.lit("key")), F.lit(1200)).alias("ok")).collect()
    assert [r["ok"] for r in got] == [c[2] for c in cases]
