"""Each stage of the corpus pipeline against a plain version, on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quern.llm import queries
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    odd = [(9001, None, "en", "s", None), (9002, "123 --", "en", "s", 6), (9003, "", None, None, 0)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out = {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        made = spark.read.parquet(path)
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokens"]
    for _, made in list(stages.values())[:-1]:
        assert made.columns == COLUMNS


def test_language_id_rejects_only_texts_without_letters(stages):
    docs, made = stages["language_id"]
    assert set(rows(made)) == {d for d, r in rows(docs).items() if r["text"] and any(map(str.isalpha, r["text"]))}


def test_line_dedup(stages):
    docs, made = stages["line_dedup"]
    want = brute.lines_left([(d, r["text"]) for d, r in rows(docs).items()])
    got = rows(made)
    assert {d: r["text"] for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_dedup_keeps_one_of_each_group(stages):
    docs, made = stages["near_dedup"]
    want = brute.components([(d, brute.fingerprint(r["text"])) for d, r in rows(docs).items()])
    assert sorted(r["doc_id"] for r in made.select("doc_id").collect()) == sorted(set(want.values()))


def test_decontamination(spark, sf_dir, stages):
    docs, made = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(rows(made)) == {d for d, r in rows(docs).items() if not brute.contamination(r["text"], items)[1]}


def test_tokens(spark, stages):
    from tokenizers import Tokenizer

    docs, made = stages["tokens"]
    lib = Tokenizer.from_file(queries.tokenizer_path(spark))
    texts = rows(docs)
    for r in made.collect():
        ids = lib.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["ids_sha256"]) == (ids, len(ids), brute.sha(" ".join(map(str, ids))))


def test_near_dedup_of_rows_without_id(spark, sf_dir, stages):
    schema = stages["near_dedup"][0].schema
    df = spark.createDataFrame([(None, "a b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9), (7, "x y z", "en", "s", 5), (7, "x y z", "en", "s", 5)], schema)
    assert sorted(str(r["doc_id"]) for r in pipeline.near_dedup(spark, df, sf_dir).collect()) == ["7", "None"]


def test_run_equals_the_stages(spark, sf_dir):
    plain = pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert plain.count() > 0 and plain.join(docs, "doc_id", "left_anti").count() == 0
    assert plain.where(F.col("n_tokens") != F.size("ids")).count() == 0


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
