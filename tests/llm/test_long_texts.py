"""Very long texts beside short ones, operator by operator."""

import hashlib
import zlib

from pyspark.sql import functions as F

from quern.llm import chat, shards, simhash, warc
from tests.llm import brute

LONG = " ".join(f"word{i % 7919} of{i % 31}" for i in range(250_000))


def docs(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")


def test_simhash(spark):
    texts = [LONG, LONG + " more", "short", None]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    want = [(i, brute.fingerprint(t)) for i, t in enumerate(texts)]
    assert {i: fp for i, (fp, _) in got.items()} == dict(want)
    assert {i: c for i, (_, c) in got.items()} == brute.components(want)


def test_shards(spark):
    texts = [LONG, "a", "b", "a", None, LONG]
    rows = shards.shard(docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    loads = {}
    for r in rows:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
    assert max(loads.values()) == 2 * (len(LONG) + 1)


def test_warc(spark):
    pages = docs(spark, [LONG, LONG, "x" * 5_000_000, None]).select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.col("text").alias("html"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(warc.read_records(warc.write_bundles(pages))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {0: (len(LONG), sha(LONG), "response", None), 1: (len(LONG), sha(LONG), "revisit", 0), 2: (5_000_000, sha("x" * 5_000_000), "response", None), 3: (0, sha(""), "response", None)}


def test_warc_records_are_the_same_in_each_run_and_name_each_other(spark):
    import pyarrow.fs as pafs
    import zstandard

    def records():
        pages = docs(spark, ["p" * 200, "p" * 200, "q"]).toDF("page_id", "html").withColumn("url", F.lit("http://a.example/")).repartition(1).sortWithinPartitions("page_id")
        (uri,) = warc.write_bundles(pages).select("bundle").distinct().first()
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            return zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read().decode()

    text = records()
    assert text == records()
    fields = [line.split(": ", 1) for line in text.split("\r\n") if ": " in line]
    ids = [v for k, v in fields if k == "WARC-Record-ID"]
    assert len(set(ids)) == 3 and [v for k, v in fields if k == "WARC-Refers-To"] == [ids[0]]


def test_chat(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + "!"), (2, 0, "user", LONG), (2, 1, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(chat.packs(df)).collect()}
    assert got == {1: (2, len(LONG) + 1, brute.sha(LONG + "!")), 2: (2, 10, brute.sha("<|im_end|>"))}


def test_licenses(spark):
    from quern.llm import licenses

    name, wording = licenses.NOTICES[0]
    lines = LONG.replace(" of7", "\n")
    rows = [(1, "a/x.py", f"{lines}\n{wording}\n{lines}"), (2, "a/y.py", lines), (3, "a/LICENSE", f"{dict(licenses.texts())[licenses.texts()[0][0]]}"), (4, "b/LICENSE", LONG)]
    got = {r["doc_id"]: (r["license"], r["via"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    whole = licenses.texts()[0][0]
    assert got == {1: (name, "header"), 2: (whole, "inherited"), 3: (whole, "file"), 4: (None, None)}


def test_every_stage_of_the_pipeline(spark, sf_dir):
    import corpus_pipeline as pipeline

    block = "a block of more than eight words that both of the documents hold"
    rows = [(1, f"{LONG}\n{block}"), (2, f"{LONG[: len(LONG) // 2]}\n{block}"), (3, f"short own text\n{block}"), (4, LONG), (5, "9 " * 500_000)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in pipeline.STAGES:
        df = stage(spark, df, sf_dir).cache()
        kept[name] = sorted(r["doc_id"] for r in df.select("doc_id").collect())
    # 4 is a copy of 1 but for the block, which stays with 1: its only line goes as a block that 1 holds
    assert kept["language_id"] == kept["line_dedup"] == [1, 2, 3, 4] and kept["near_dedup"] == kept["decontamination"] == kept["tokens"] == [1, 2, 3, 4]
    assert df.where("doc_id = 1").first()["n_tokens"] > 500_000 and df.where("doc_id = 4").first()["n_tokens"] == 0
