"""Decontamination with short items, long texts, and with nothing broadcast."""

import random
from collections import Counter

import pytest

from quern.llm import winnow
from tests.llm import brute


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    said = lambda n: " ".join(f"W{rng.randrange(40)}" if rng.random() < 0.7 else "\u00e9t\u00e9" for _ in range(n))
    items = [(1, said(30)), (2, said(12)), (3, said(10)), (4, "w1 w2"), (5, said(7)), (6, ""), (7, None), (8, "w1, W2!"), (None, said(11)), (9, said(9))]
    texts = [t for _, t in items if t]
    docs = []
    for d in range(120):
        parts = [said(rng.randrange(15))]
        for _ in range(rng.randrange(3)):
            ws = rng.choice(texts).split()
            at = rng.randrange(len(ws))
            parts += [" ".join(ws[at : at + rng.randrange(1, 20)]), said(rng.randrange(6))]
        docs.append((d, " . ".join(parts)))
    docs += [(500, None), (501, ""), (502, "--- !"), (3, docs[3][1]), (504, "w1"), (505, (texts[0] + " ") * 400), (506, said(9_000)), (None, texts[1]), (None, None)]
    long_items = [(i, t) for i, t in items if t is None or len(winnow_words(t)) >= 10]
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").withColumn("tokens", _extra())
    return docs, items, long_items, make


def winnow_words(t):
    return brute.words(t)


def _extra():
    from pyspark.sql import functions as F

    return F.lit("clashing")


@pytest.mark.parametrize("most", [100_000, 0])
@pytest.mark.parametrize("short", [True, False])
def test_equals_plain_version(spark, tables, monkeypatch, most, short):
    docs, items, long_items, make = tables
    items = items if short else long_items
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", most)
    found = winnow.digest(winnow.decontaminate(make(docs, "doc_id"), make(items, "item_id")))
    got = Counter((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found.collect())
    want = Counter()
    for d, t in docs:
        n, hit, _ = brute.contamination(t, items)
        _, _, ids = brute.contamination(t, [(i, x) for i, x in items if i is not None])
        want[str(d), n, hit, len(ids), brute.sha(",".join(ids))] += 1
    assert got == want
    assert winnow.decontaminate(make(docs, "doc_id"), make(items, "item_id").limit(0)).where("size(spans) > 0").count() == 0
    assert winnow.decontaminate(make(docs, "doc_id").limit(0), make(items, "item_id")).count() == 0


def test_no_words_are_shuffled(spark, tables, monkeypatch):
    docs, items, _, make = tables
    monkeypatch.setattr(winnow, "BROADCAST_ROWS", 0)
    seen = []
    keep = winnow.written

    def told(df, label):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString() if label == "winnow-places" else "")
        return keep(df, label)

    monkeypatch.setattr(winnow, "written", told)
    winnow.decontaminate(make(docs, "doc_id"), make(items, "item_id"))
    (plan,) = [p for p in seen if p]
    join = plan[plan.index("Join LeftSemi") :]
    above = join[: join.index("Generate")]
    assert "text" not in above and "tokens" not in above
