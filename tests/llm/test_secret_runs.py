"""The class of run characters: looked up in a table, and the same one that the SQL has."""

from pyspark.sql import functions as F

from quern.llm import secretscan


def test_the_class_is_the_same_for_every_character(spark):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    t = F.col("t")
    got = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace(t, secretscan.RUN, "").alias("a"), F.regexp_replace(t, secretscan.LOOKED_UP, "").alias("b")).first()
    assert got["a"] == got["b"] == "".join(chr(c) for c in range(128) if chr(c) not in secretscan.ALPHABET)


def test_no_text_is_scanned_by_ranges(spark):
    docs = spark.createDataFrame([(1, "token = abcdefgh1234 and a long identifier_of_some_length")], "doc_id long, text string")
    found = secretscan.scan(docs, secretscan.Model((0,) * secretscan.WIDTH**2))
    words = secretscan.ordinary_words(docs, least_docs=1)
    for df in (found, words):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert secretscan.RUN not in plan and secretscan.LOOKED_UP in plan
    assert {r["word"] for r in words.collect()} == {"identifier_of_some_length"}
