"""The divergence audit against sums over every term of every pair of sources."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"
SCALE = 1_000_000_000


def plain(docs, least=3, top=200):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))) for _, text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, ts) for x, s, ts in rows if x == lang]
        held = Counter(t for _, ts in mine for t in set(ts))
        kept = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        count = {s: Counter() for s, _ in mine}
        for s, ts in mine:
            count[s].update(t for t in ts if held[t] >= least)
        whole = sum(count.values(), Counter())
        mass = lambda c: {t: 1 + SCALE * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: mass(c) for s, c in count.items()}, mass(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def corpus(seed, n, sources):
    rng = random.Random(seed)
    pool = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["Über", "ÉTÉ", "été", "Zoë"]
    text = lambda: " ".join(rng.choice(pool[: rng.randrange(5, 104)]) for _ in range(rng.randrange(25)))
    return [(i, rng.choice([text(), text(), text(), None, ""]), rng.choice(["en", "en", "de", None, ""]), rng.choice([*(f"s{k}" for k in range(sources)), None])) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_against_all_terms(spark):
    docs = corpus(1, 200, 8)
    docs += [(900 + k, "only once here", "fr", f"s{k}") for k in range(3)] + [(950, "a word", "it", "s1"), (951, None, "pt", "s1"), (952, "", "pt", "s2")]
    want = plain(docs)
    assert rows(divergence.audit(spark.createDataFrame(docs, DOCS))) == want
    assert {r[2] for r in want if r[0] == "it"} == set() and {r[4] for r in want if r[0] == "pt"} == {0}


def test_odd_rows(spark):
    long = "Lang! " * 300_000 + "kurz kurz"
    docs = [(1, long, "de", "a"), (1, long, "de", "a"), (None, long, "de", "b"), (None, "kurz", "de", "b"), (2, "Kurz KK", "de", None), (3, "kurz", "de", "\U0001f600")]
    df = spark.createDataFrame(docs, DOCS)
    want = plain(docs)
    assert rows(divergence.audit(df)) == want
    clash = df.withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).withColumn("no", F.lit("x")).withColumn("terms", F.lit(3)).withColumn("once", F.lit(1))
    assert rows(divergence.audit(clash)) == want
    assert rows(divergence.audit(df.limit(0))) == []
    assert rows(divergence.audit(df, top=1)) == plain(docs, top=1)


def test_blocks_of_sources_and_small_memory(spark):
    df = spark.createDataFrame(corpus(7, 300, 9), DOCS)
    cells = divergence.kept_terms(divergence.term_counts(df)).cache()
    groups = divergence.group_sizes(df, cells).cache()
    count = lambda d: sorted(map(tuple, d.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m")).collect()))
    whole = count(divergence.joint_counts(cells, groups))
    assert whole and count(divergence.joint_counts(cells, groups, block=3, most=50, together=40)) == whole
    tallies = divergence.histograms(divergence.joint_counts(cells, groups, block=2), cells, groups)
    v = {r["lang"]: r["v"] for r in groups.collect()}
    sums = tallies.groupBy("lang", "a", "b").agg(F.sum("m").alias("m"), F.min("m").alias("least"), F.max(F.struct("na", "nb")).alias("x")).collect()
    assert all(r["m"] == v[r["lang"]] and r["least"] > 0 for r in sums)


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**12, 3 * 10**12, 10**6)], "c long, n long, v long")
    got = df.select(divergence.mass(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()["p"]
    assert got == 1 + SCALE * (10**12 + 1) // (3 * 10**12 + 10**6)
