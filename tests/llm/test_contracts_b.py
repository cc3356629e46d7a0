"""Neighbours, line dedup, licences, WARC bundles and chat packs against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, chat, linededup, warc
from tests.llm import brute


# -- nearest neighbours --


def true_neighbours(rows, k):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = true_neighbours(rows, 20)
    got = {}
    for r in ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == set(want)
    hits = 0
    vec = dict(rows)
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, 21))
        assert all(abs(s - np.dot(np.array(vec[q], float), np.array(vec[i], float))) < 1e-12 for i, s, _ in found)
        assert [(-s, i) for i, s, _ in found] == sorted((-s, i) for i, s, _ in found)
        hits += len({i for i, *_ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (40, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("x"))
    got = {}
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 1.0), (2, 1.0), (2, 1.0), (None, 1.0), (20, 0.0)], 20: [(0, 0.0), (1, 0.0), (2, 0.0), (2, 0.0), (None, 0.0)]}
    assert ann.search(df.limit(0)).count() == 0


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(1).normal(size=(700, 8))
    tree = ann.Tree.fit(x)
    assert sorted(tree.visit(x[:1], tree.leaves)[0]) == list(range(tree.leaves))
    assert ann.Tree.fit(np.ones((500, 3))).assign(np.ones((4, 3))).tolist() == [0] * 4
    assert all((c in tree.children[p]) for p in range(len(tree.children)) for c in tree.children[p])


def test_neighbours_are_told_apart_by_row(spark):
    """Rows of one id with different vectors see each other; of equal rows one is the query's own."""
    big = 2**63 - 1
    rows = [(20, [1.0, 0.0]), (20, [0.5, 1.0]), (40, [2.0, 2.0]), (40, [2.0, 2.0]), (big, [1.0, 1.0]), (None, [1.0, 1.0])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[40]) == [(1, 40, 8.0), (2, big, 4.0), (3, None, 4.0), (4, 20, 3.0), (5, 20, 2.0)]
    own = lambda q, skip: [i for s, _, i in sorted((-float(np.dot(q, v)), i if i is not None else 2**70, str(i)) for n, (i, v) in enumerate(rows) if n != skip)]
    want = sorted([*enumerate(own(rows[0][1], 0), 1), *enumerate(own(rows[1][1], 1), 1)])
    assert sorted((r, str(i)) for r, i, _ in got[20]) == want


def test_neighbours_of_large_vectors_are_exact(spark):
    """A visit of all leaves gives the true neighbours, whatever the lengths of the vectors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) * 10.0 ** rng.integers(-3, 7, size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0, calibration=150).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: [i for i, _ in found] for q, found in true_neighbours(rows, 20).items()}
    assert got == want


def test_neighbours_recall_beyond_the_calibration(spark):
    """Recall over all queries at 2,000 rows and over all rows as queries of which few calibrated; leaves are left out."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    rough = x @ x.T
    np.fill_diagonal(rough, -np.inf)
    want = {int(ids[i]): set(ids[np.lexsort((ids, -rough[i]))[:20]].tolist()) for i in range(len(ids))}
    hits = n = 0
    for r in ann.search(df, F.col("vec_id") >= 0, calibration=100).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect():
        hits += len(want[r["query_id"]] & set(r["found"]))
        n += 1
    assert n == len(rows) and 0.9 <= hits / (20 * n) < 1


# -- line dedup --


def test_patience_is_an_alignment():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        got = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_line_dedup(spark, sf_dir):
    """Against every pair of documents, in code of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    cut, want = brute.lines_cut(rows), brute.lines_left(rows)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert {d: r["text"] for d, r in got.items()} == want
    assert sum(t != want[d] for d, t in rows) > 50
    assert {d: r["n_removed"] for d, r in got.items()} == {d: len(x) for d, x in cut.items()}
    assert {d: r["n_lines"] for d, r in got.items()} == {d: len(t.split("\n")) for d, t in rows}
    # nothing is lost: each line of the corpus is left somewhere
    left = {x.strip() for t in want.values() for x in t.split("\n")}
    assert {x.strip() for _, t in rows for x in t.split("\n")} - {""} <= left


def test_line_dedup_odd_rows(spark):
    long = "one two three four five six seven eight nine"
    rows = [(1, long + "\nown"), (2, "mine\n " + long + " \n\nshort"), (3, None), (4, ""), (None, "z\n" + long), (2, "mine\n " + long + " \n\nshort"), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("me", F.lit(1))
    got = sorted(((str(r["doc_id"]), r["text"], r["n_removed"], r["sources"]) for r in linededup.dedup_lines(df).collect()), key=lambda r: r[0])
    assert got == [("1", "own", 1, []), ("2", "mine\n\nshort", 1, []), ("2", "mine\n\nshort", 1, []), ("3", None, 0, []), ("4", "", 0, []), ("5", "short", 0, []), ("None", "z\n" + long, 0, [])]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# -- WARC --


def test_warc_round_trip(spark, sf_dir):
    big = "<p>" + "x" * 200 + "</p>"
    odd = [(9001, "http://a", big), (9002, "http://b\r\nX: y%", big), (9002, None, big), (9000, "u", big), (9000, "u2", big), (None, "n", big), (9003, "s", "tiny"), (9004, "s", "tiny"), (9005, None, None), (9006, "é", "\r\n\r\né" * 60)]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").union(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("digest", F.lit("x"))
    rows = [(r["page_id"], r["url"], (r["html"] or "").encode()) for r in pages.collect()]
    index = warc.write_bundles(pages)
    assert index.count() == len(rows)
    first = {}
    for p, _, b in rows:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    want = sorted((str(p), len(b), hashlib.sha256(b).hexdigest(), *(("response", None) if len(b) < 100 or first.get(b, p) == p else ("revisit", first[b]))) for p, _, b in rows)
    got = warc.digest(warc.read_records(index)).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    urls = sorted(str((r["page_id"], r["url"])) for r in warc.read_records(index).collect())
    assert urls == sorted(str((p, u)) for p, u, _ in rows)
    assert warc.digest(warc.read_records(warc.write_bundles(pages.limit(0)))).count() == 0


def test_bundles_are_plain_zstandard(spark, sf_dir):
    import pyarrow.fs as pafs
    import zstandard

    index = warc.write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    for (uri,) in index.select("bundle").distinct().collect():
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            raw = f.read()
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


# -- chat --


def plain_chat(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        spoken = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), brute.sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(spoken), brute.sha(spoken))
    return out


@pytest.mark.parametrize("size", [1, 500, chat.PACK])
def test_chat(spark, sf_dir, size):
    said = "<|im_end|><|im_start|>assistant ok"
    odd = [(-1, 0, "user", said), (-1, 1, "assistant", said), (-2, 0, None, "<\\|x <\\\\| \\"), (-2, None, "assistant", None), (-3, 0, "a\nb\\n<|im_end|>", "😀"), (-3, 0, "assistant", "é\n"), (None, 1, "assistant", "lost"), (-4, 0, "user", said), (-4, 1, "assistant", said), (-4, 1, "assistant", said)]
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")).withColumn("keys", F.lit(1))
    want = plain_chat([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
    packed = chat.packs(df, size=size)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(packed).collect()}
    assert got == want


def test_chat_shares_prefixes(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} {'x' if t < 3 else c}") for c in range(20) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        (pack,) = chat.packs(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(pack["nodes"]) == 3 + 20
    for n in pack["nodes"]:
        above = sum(r["end"] - r["start"] for r in n["attends"])
        assert n["position"] == above
        path = [pack["text"][x["start"] : x["end"]] for x in ancestors(pack["nodes"], n)][::-1]
        assert "".join(pack["text"][r["start"] : r["end"]] for r in n["attends"]) == "".join(path)
    assert chat.digest(chat.packs(df.limit(0))).count() == 0


def ancestors(nodes, n):
    while n["parent"] >= 0:
        n = nodes[n["parent"]]
        yield n
