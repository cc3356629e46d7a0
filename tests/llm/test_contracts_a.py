"""Tokenizer, SimHash, sharding, language ID and decontamination against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, langid, queries, shards, simhash, winnow
from tests.llm import brute

ODD = ["", " ", "ΑΣ ΑΣΑ Σ", "<|endoftext|>x<|endoftext|", "a<|startoftext|>B  c", "İstanbul I'm we'VE don't '''s", "\x1c\x1d a\x85b c\xa0d", "é é ﬁ ½ ²³ 123 ٣٤", "😀😃 日本語", "\x00\x01", "a" * 3000, "<|ENDOFTEXT|>", "ǅ ŉ ẞ Ω K Å", None]


def docs_of(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("ids", F.lit("x")).withColumn("score", F.lit(1)).withColumn("shard", F.lit(7)) if extra else df


def test_bpe_equals_library(spark, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(spark)
    lib = Tokenizer.from_file(path)
    texts = [*ODD, *[r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]]
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs_of(spark, texts, extra=True), path).collect()}
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_bpe_memo_restart():
    import public_tokenizers

    tok = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"), max_memo=3)
    first = [x.tolist() for x in tok.encode_batch(["the cat sat", "on other mats"])]
    assert first == [tok.encode(t).tolist() for t in ("the cat sat", "on other mats")]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    path = queries.tokenizer_path(spark)
    assert bpe.digest(bpe.encode_decode(none, path)).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert shards.shard(none).count() == 0
    model = langid.fit(none.withColumn("lang", F.lit("en")))
    assert langid.predict(none, model).count() == 0
    bench = none.withColumnRenamed("doc_id", "item_id")
    assert winnow.digest(winnow.decontaminate(none, bench)).count() == 0
    got = winnow.digest(winnow.decontaminate(docs_of(spark, ["a b", None]), bench)).collect()
    assert sorted((r["n_words"], r["contaminated"]) for r in got) == [(0, False), (2, False)]


def test_simhash(spark, sf_dir):
    texts = ["", None, "one", "One", "a b c", *[r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]]
    got = simhash.near_duplicates(docs_of(spark, [*texts, texts[7], texts[9]], extra=True)).collect()
    prints = [(i, brute.fingerprint(t)) for i, t in enumerate([*texts, texts[7], texts[9]])]
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.components(prints)


@pytest.mark.parametrize("chunk", [16384, 40])
def test_links_find_all_close_pairs(spark, chunk):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:100]:
        for _ in range(4):
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            prints.add(p)
    prints |= {p ^ 1 << rng.randrange(64) for p in [0] * 60} | {(1 << a) | (1 << b) for a in range(20) for b in range(20)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(df, chunk=chunk)).collect()}
    want = brute.components([(p, p) for p in prints])
    classes = lambda m: sorted(sorted(p for p in prints if m.get(p, p) == c) for c in {m.get(p, p) for p in prints})
    assert classes(roots) == classes(want)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert shards.shard(df).count() == 4
    bench = spark.createDataFrame([(1, "b c d"), (None, "z"), (2, None)], "item_id long, text string")
    got = winnow.digest(winnow.decontaminate(df, bench)).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"], r["n_items"]) for r in got) == [("3", 3, 1), ("3", 3, 1), ("None", 1, 0), ("None", 3, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_minimax_is_smallest(spark, seed):
    rng = random.Random(seed)
    groups = {f"{rng.getrandbits(20):05x}": rng.choice([1, 5, 30, 200]) for _ in range(60)}

    def told(prefixes, digits):
        out = {}
        for k, n in groups.items():
            if any(k.startswith(p) for p in prefixes):
                size, count = out.get(k[:digits], (0, 0))
                out[k[:digits]] = (size + n, count + 1)
        return [shards.Segment(p, *x) for p, x in out.items()]

    finer = lambda wanted: [s for w in wanted for s in told([w.prefix], len(w.prefix) + 1)]
    cap, cuts = shards.minimax(told([""], 1), 8, finer)
    ordered = [n for _, n in sorted(groups.items())]
    assert cap == brute.capacity(ordered, 8)
    held = [0] * 8
    for k, n in groups.items():
        held[sum(k >= c for c in cuts)] += n
    assert max(held) <= cap and len(cuts) < 8


def test_shards(spark, sf_dir):
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = shards.shard(docs).collect()
    assert len(got) == len(texts)
    by_text, by_shard = {}, {}
    for r in got:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        assert by_text.setdefault(body, r["shard"]) == r["shard"]
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) == set(range(8))
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op7_langid(spark, sf).collect() if r["held_out"]]
    assert len(got) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([("the cat", "en"), ("le chat", "fr"), ("x", None), (None, "en")], "text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["en", "fr"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs_of(spark, ["the", None, "123 !", "", "chat"], extra=True), model).collect()}
    assert [got[i][0] for i in range(5)] == ["en", "und", "und", "und", "fr"]
    assert all(0 <= s <= 1 for _, s in got.values())


def test_decontamination(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "tiny item here"), (901, "One"), (902, "!!"), (903, None), (900, "again tiny"), (904, " ".join(["re"] * 30))]
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["x TINY item, here one", "", None, items[0][1], "pre " + " ".join(brute.words(items[1][1])[:10]) + " post", " ".join(brute.words(items[1][1])[:9]), " ".join(["re"] * 50), " ".join(["re"] * 9)]
    docs = docs_of(spark, texts, extra=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in winnow.digest(winnow.decontaminate(docs, bench)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, hit, found = brute.contamination(text, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), brute.sha(",".join(found)), hit > 0), i
