"""Language identification against plain naive Bayes, one n-gram at a time."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid

MASK = (1 << 64) - 1


def grams(text):
    codes = [ord(c) for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            mixed = n
            for c in codes[i : i + n]:
                mixed = ((mixed ^ c) * 0x9E3779B97F4A7C15) & MASK
            yield mixed >> 49


def plain(train, texts):
    labels = sorted({x for _, x in train})
    counts = {x: Counter() for x in labels}
    for t, x in train:
        counts[x].update(grams(t))
    sums = {x: sum(c.values()) + 0.5 * 2**15 for x, c in counts.items()}
    out = []
    for t in texts:
        if t is None or not any(map(str.isalpha, t)):
            out.append(("und", 0.0))
            continue
        score = {x: math.log(sum(y == x for _, y in train) / len(train)) for x in labels}
        for g in grams(t):
            for x in labels:
                score[x] += math.log((counts[x][g] + 0.5) / sums[x])
        best = max(labels, key=lambda x: score[x])
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


@pytest.mark.parametrize("piece", [1, 2, 7, 1000, 1 << 20])
def test_batches_hold_every_gram_once(piece):
    texts = ["", "a", "ab", "Über ALLES, 日本語 😀" * 5, "x" * 23, "hello world"]
    got = Counter()
    for rows, starts, found in langid.batches(texts, piece):
        for row, a, b in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(found)], strict=True):
            got.update((row, g) for g in found[a:b].tolist() if g != langid.NONE)
    assert got == Counter((i, g) for i, t in enumerate(texts) for g in grams(t))


def test_equals_plain_naive_bayes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang")
    docs = docs.union(spark.createDataFrame([(9001, None, "en"), (9002, "12 3", None), (9003, "", None), (9004, "é", None), (9004, "é", None)], docs.schema))
    train = [(r["text"], r["lang"]) for r in docs.where("doc_id % 2 = 0 AND lang IS NOT NULL AND text IS NOT NULL").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d: p for (d, _), p in zip(rows, plain(train, [t for _, t in rows]), strict=True)}
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-6)


def test_long_text(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")], "text string, lang string")
    model = langid.fit(train)
    long = "le chat " * 300_000  # more than two pieces
    names, scores = model.predict([long, "the mat", long + "the cat " * 900_000])
    assert names == ["fr", "en", "en"] and np.all(scores > 0.5)
