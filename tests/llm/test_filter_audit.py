"""The filter interaction audit against every order applied one filter at a time."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from quern.llm import filteraudit

DOCS = "doc_id long, text string, source string"


def plain(docs, labels):
    """part, order, step -> the seven numbers, by applying each order to each document."""
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t) == 1} for x in (lambda q, t: q, lambda q, t: t))
    failed = []
    for d, text, source in docs:
        t = text or ""
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        bad = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        failed.append((source or "", d, {k for k, x in bad.items() if x}))
    out, shares = {}, {}
    for part in {p for p, _, _ in failed}:
        mine = [(d, x) for p, d, x in failed if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
    return {key: (*v, shares[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def got(spark, docs, labels):
    df = filteraudit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(found) == len(rows)
    return found


def test_every_order(spark):
    rng = random.Random(5)
    kinds = [lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([20, 60, 90]))), lambda: "Ab\tCD\x0b\n" * 40, lambda: "$ 5 a", lambda: " x y " * 30, lambda: "", lambda: None, lambda: "same same " * 30]
    docs = [(i, rng.choice(kinds)(), rng.choice(["a", "b", "", None])) for i in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_odd_rows(spark):
    docs = [(None, "x", "a"), (2, "x", "a"), (2, "x", "a"), (3, "x", "b"), (None, None, "b"), (1, "y " * 400_000, "b"), (4, "y " * 400_000, None)]
    labels = [(2, 1, 0), (2, 1, None), (None, 1, 1), (3, 0, 1), (9, 1, 1)]
    found = got(spark, docs, labels)
    assert found == plain(docs, labels)
    assert found["a", "EABCD", 1][:2] == (3, 0) and found["b", "EABCD", 1][:2] == (2, 1)
    assert found[("", "EABCD", 1)][:2] == (0, 1)  # the copy of a long text
    assert got(spark, [], labels) == {}
    clash = spark.createDataFrame(docs, DOCS).withColumn("mask", F.lit("m")).withColumn("part", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("words", F.lit(3))
    assert filteraudit.audit(clash, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))).count() == len(found)
    assert filteraudit.audit(clash, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("good_lost")).first()[0] == 0


def test_survivors_of_every_subset(spark):
    rng = random.Random(3)
    masks = [rng.randrange(16) for _ in range(300)]
    counts = spark.createDataFrame([("p", m) for m in masks], "part string, mask int").groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    row = filteraudit.survivors(counts, 4).first()
    assert row["n"] == [sum(m & s == 0 for m in masks) for s in range(16)]
