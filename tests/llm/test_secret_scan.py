"""The secret scan against plain patterns and plain Markov chains, and on planted secrets."""

import base64
import hashlib
import random
import re
from collections import Counter
from math import log2

from pyspark.sql import functions as F

from quern.llm import secretscan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
RUN = re.compile(r"(?:[A-Za-z0-9+/_-]|[^\x00-\x7f])+")


def base_spans(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return sorted(out + [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 32], key=lambda s: (s[1], secretscan.KINDS.index(s[0])))


def chains(texts):
    """Scores of pairs from the two labelled samples."""
    sha = lambda s: hashlib.sha256(s.encode())
    rand, held = [], Counter()
    for i in range(1024):
        rand += [sha(f"hex{i}").hexdigest(), base64.b64encode(sha(f"base64{i}").digest()).decode().rstrip("="), re.sub("[+/=]", "", base64.b64encode(sha(f"upper{i}").digest()).decode().upper())]
    for t in texts:
        cut, at = [], 0
        spans = sorted({m.span() for m in ASSIGN.finditer(t)} | {m.span() for m in ACCESS.finditer(t) if len(m[0]) >= 16} | {m.span() for m in HEX.finditer(t) if len(m[0]) >= 32})
        for a, b in spans:
            if a >= at:
                cut.append(t[at:a])
                at = b
        rest = " ".join([*cut, t[at:]])
        held.update({w for w in RUN.findall(rest) if len(w) >= 8 and w.isascii()})
    ordinary = [w for w, n in held.items() if n >= 3] + [str(int(sha(f"number{i}").hexdigest()[:15], 16)) for i in range(1024)]
    pairs = lambda ws: Counter(w[i : i + 2] for w in ws for i in range(len(w) - 1))
    a, b = pairs(rand), pairs(ordinary)
    of = lambda c: Counter({x: sum(n for p, n in c.items() if p[0] == x) for x in secretscan.ALPHABET})
    na, nb, k = of(a), of(b), len(secretscan.ALPHABET)
    return {x + y: round(1000 * (log2((a[x + y] + 1) / (na[x] + k)) - log2((b[x + y] + 1) / (nb[x] + k)))) for x in secretscan.ALPHABET for y in secretscan.ALPHABET}


def all_spans(text, scores):
    base, out, at = base_spans(text), [], 0
    for a, b in [*(m.span() for m in ASSIGN.finditer(text)), (len(text), None)]:
        for m in RUN.finditer(text[at:a]):
            w = m[0]
            plain = len(w) >= 20 and w.isascii() and not re.search("[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}", w)
            if plain and sum(scores[w[i : i + 2]] for i in range(len(w) - 1)) >= 20_000:
                out.append(("model", at + m.start(), at + m.end()))
        at = b
    return sorted(base + out, key=lambda s: (s[1], secretscan.KINDS.index(s[0])))


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def rows(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in secretscan.digest(secretscan.scan(df, secretscan.train(df))).collect()}


def check(spark, texts):
    got, scores = rows(spark, texts), chains([t or "" for t in texts])
    for i, t in enumerate(texts):
        base, r = base_spans(t or ""), got[i]
        assert r["spans"] == told(all_spans(t or "", scores)), (i, (t or "")[:200])
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secretscan.KINDS[:3]] == [sum(s[0] == k for s in base) for k in secretscan.KINDS[:3]]
    return got


def test_patterns_and_models(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["configuration", "getUserNameFromRequest", "max_connection_count", "internationalization", "é", "Übersetzungsbüro", "the", "😀", "src/main/resources/application", "0123456789012345678901234567"]
    bits = [
        lambda: rng.choice(words),
        lambda: f"{rng.choice(['Token', 'API_KEY', 'apikey', 'passwd', 'PassWord'])}{rng.choice(['', chr(34)])}{rng.choice([' = ', ':', '= '])}{rng.choice(['', chr(39)])}{''.join(rng.choices(letters + '+/_.=-', k=rng.choice([3, 7, 8, 30])))}",
        lambda: "AKIA" + "".join(rng.choices("ABCXYZ0189", k=rng.choice([5, 11, 12, 16]))),
        lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([12, 31, 32, 64]))),
        lambda: "".join(rng.choices(letters, k=rng.choice([18, 24, 43]))),
        lambda: rng.choice(["token=secret:abcdefgh", "xAKIAAKIAABCDEFGHIJ", "secret = tok", "K" + "token:12345678", "toſen=12345678901"]),
    ]
    texts = [" ".join(rng.choice(bits)() for _ in range(rng.randrange(30))) + rng.choice(["", "\n", "."]) for _ in range(150)]
    got = check(spark, [*texts, None, "", "\n"])
    assert sum("model:" in r["spans"] for r in got.values()) > 20
    assert sum(len(r["spans"]) == 0 for r in got.values()) >= 3


def test_real_texts(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    keys = [base64.b64encode(hashlib.sha256(str(i).encode()).digest()).decode().rstrip("=") for i in range(40)]
    planted = [f"{t} {k} more" for t, k in zip(texts, keys, strict=False)]
    got = check(spark, planted + texts[40:])
    assert sum("model:" in got[i]["spans"] for i in range(40)) >= 38
    assert sum("model:" in got[i]["spans"] for i in range(40, len(texts))) == 0


def test_long_text_in_linear_time(spark):
    line = 'export TOKEN="Zm9vYmFyYmF6cXV4MTIz" and 0123456789abcdef0123456789abcdef01\n'
    got = rows(spark, [line * 20_000, "a" * 2_000_000])
    assert got[0]["n_assign"] == got[0]["n_hex"] == 20_000 and got[0]["spans"].endswith(f":{20_000 * len(line) - 1}")
    assert got[1]["n_hex"] == 1


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "token=12345678"), (1, "token=12345678"), (1, "token=12345678")], "doc_id long, text string")
    model = secretscan.train(df.limit(0))
    assert [r["spans"] for r in secretscan.digest(secretscan.scan(df, model)).collect()] == ["assign:0:14"] * 3
    assert secretscan.scan(df.limit(0), model).count() == 0
    clash = df.withColumn("spans", F.lit(1)).withColumn("__t", F.lit("t")).withColumn("word", F.lit("w")).withColumn("found", F.lit(2))
    out = secretscan.scan(clash, model)
    assert sorted(out.columns) == ["__t", "doc_id", "found", "spans", "text", "word"] and {r["__t"] for r in out.collect()} == {"t"}
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
