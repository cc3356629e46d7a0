"""The stored positional index and commits by pointer."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quern.operators import search, textindex
from quern.sources import commits


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["don't", "ab"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["head w1", "", None, "ab"])) for i in range(600)]
    rows += [(1000 + i, "w1 " * (50 + i) + "w2", "w3 w1") for i in range(5)] + [(2000, None, None), (2001, "AB. ab? aB ab", "Don't")]
    docs = spark.createDataFrame(rows, "id long, body string, title string")
    return docs, textindex.build(docs, "id", {"A": "title", "C": "body"}, str(tmp_path_factory.mktemp("index")), block_docs=25, buckets=5)


GROUPS = [
    [search.Group(("w1",))],
    [search.Group(("w1", "w7"), 2), search.Group(("don't",)), search.Group(("missing",))],
    [search.Group(("w1 w2", "ab")), search.Group(("w1 w1",)), search.Group(("ab ab",))],
    [search.Group(("missing",))],
]


@pytest.mark.parametrize("groups", GROUPS)
def test_same_rows_as_the_scan(corpus, groups):
    docs, index = corpus
    want = search.matched_groups(docs, "id", {"A": "title", "C": "body"}, groups)
    rows = lambda d, c: sorted(map(tuple, d.select(c, "group", "weight", "field", "tf").collect()))
    assert rows(textindex.matched(index, groups), "doc") == rows(want, "id")
    for limit in (3, 20, 5000):
        found = textindex.top(index, groups, limit, first=2).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, search.text_candidates(want, "id", limit).collect()))


def test_blocks_under_the_threshold_are_not_scored(corpus, monkeypatch):
    _, index = corpus
    scored = []
    whole = textindex.matched

    def seen(index, groups, blocks=None):
        scored.append(len(blocks) if isinstance(blocks, list) else blocks.count())
        return whole(index, groups, blocks)

    monkeypatch.setattr(textindex, "matched", seen)
    best = textindex.top(index, [search.Group(("w1",))], 3, first=5).collect()
    assert {r["doc"] for r in best} == {1002, 1003, 1004}
    assert sum(scored) < index.blocks * 2 // 3


def test_plan_reads_the_index_alone(corpus):
    _, index = corpus
    df = textindex.matched(index, [search.Group(("w1",))])
    assert all(index.folder.split(":")[-1] in f for f in df.inputFiles())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    limits = textindex.bounds(index, [search.Group(("w1",))])._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in limits


def test_an_index_is_known_by_its_source(spark, tmp_path):
    docs, root = spark.createDataFrame([(1, "a b"), (None, "c")], "id long, t string"), str(tmp_path / "i")
    assert textindex.current(spark, root) is None
    made = textindex.build(docs, "id", {"C": "t"}, root, source="one")
    assert textindex.current(spark, root, "one") == made and textindex.current(spark, root, "two") is None
    assert textindex.matched(made, [search.Group(("c",))]).count() == 0
    empty = textindex.build(docs.limit(0), "id", {"C": "t"}, root)
    assert textindex.top(empty, [search.Group(("a",))]).count() == 0 == textindex.top(empty, [search.Group(("!",))]).count()


def test_readers_never_miss_a_version(spark, tmp_path):
    root = str(tmp_path / "t")
    write = lambda n: lambda folder: spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(folder)
    commits.commit(spark, root, write(0))
    seen, failed, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.append(sorted(r["id"] for r in commits.read(spark, root).collect()))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(1, 6):
        commits.commit(spark, root, write(n), {"n": n}, keep=4)
    stop.set()
    reader.join()
    assert not failed and len(seen) > 1
    assert all(ids == list(range(ids[0], ids[0] + 10)) and ids[0] % 10 == 0 for ids in seen)
    assert commits.current(spark, root).properties == {"n": 5}
    assert sorted(p.name[:2] for p in (tmp_path / "t").iterdir()) == ["_c", "v-", "v-", "v-", "v-"]


def test_conflicts_and_half_written_pointers(spark, tmp_path):
    root = str(tmp_path / "t")
    first = commits.commit(spark, root, lambda f: spark.range(1).write.parquet(f))
    spark.range(2).write.parquet(f"{root}/v-x")
    commits.point(spark, root, f"{root}/v-x", after=first)
    with pytest.raises(commits.Conflict):
        commits.point(spark, root, f"{root}/v-y", after=first)
    (tmp_path / "t" / "_commits" / f"{7:020d}.json").write_text('{"folder": "')
    assert commits.read(spark, root).count() == 2
    commits.commit(spark, root, lambda f: spark.range(3).write.parquet(f))
    assert commits.current(spark, root).number == 8 and commits.read(spark, root).count() == 3
    with pytest.raises(FileNotFoundError):
        commits.read(spark, str(tmp_path / "none"))
    assert commits.signature(spark, root) != commits.signature(spark, f"{root}/v-x")


def test_workspace(spark):
    assert commits.workspace(spark)


def test_similar_sets_equal_all_pairs(spark):
    from quern.operators import joins

    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abcde", k=rng.randrange(1, 9))) for _ in range(250)} | {"aaaa", "aaaaa", "a"})
    grams = {w: {("  " + w + " ")[i : i + 3] for i in range(len(w) + 1)} for w in words}
    sets = spark.createDataFrame([(w,) for w in words], "w string").withColumn("grams", joins.trigrams(F.col("w")))
    ordered = joins.by_rarity(sets, "w", joins.gram_counts(sets)).cache()
    for least in (0.3, 0.5, 0.8, 1.0):
        got = joins.similar_sets(ordered, "w", ordered.withColumnRenamed("w", "v"), "v", least).collect()
        want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in words for b in words}
        assert {(r["w"], r["v"]): r["similarity"] for r in got} == {k: v for k, v in want.items() if v >= least} and len(got) == len({(r["w"], r["v"]) for r in got})
    # no gram is joined beyond the prefix
    cut = {r["w"]: r["p"] for r in ordered.select("w", joins.prefix(F.col("grams"), 0.5).alias("p")).collect()}
    assert all(len(cut[w]) == len(grams[w]) - -(-len(grams[w]) // 2) + 1 for w in words)
    df = {g: sum(g in s for s in grams.values()) for g in set().union(*grams.values())}
    assert all(max(df[g] for g in p) <= min([df[g] for g in grams[w] - set(p)], default=10**9) for w, p in cut.items())


def test_stored_terms_expand_like_the_vocabulary(spark, tmp_path):
    docs = spark.createDataFrame([("nation nations national natoin",), ("weather whether nation",), (None,)], "t string")
    root = str(tmp_path / "terms")
    terms, counts = search.stored_terms(docs, ["t"], root, "s1")
    words = ["nation", "wheather", "zzzz", "natoins"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(search.expand(words, terms, counts=counts)) == rows(search.expand(words, search.vocabulary(docs, ["t"]))) != []
    before = commits.current(spark, root)
    search.stored_terms(docs, ["t"], root, "s1")
    assert commits.current(spark, root) == before
    search.stored_terms(docs, ["t"], root, "s2")
    assert commits.current(spark, root).number == before.number + 1


# The published sample of words with their Porter2 stems.
STEMS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid
consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu
conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc
constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel
kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot"""


def test_stems_of_the_published_sample():
    from quern.functions.stems import stem

    words = STEMS.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))
    more = {"generously": "generous", "ties": "tie", "cries": "cri", "gas": "gas", "hopping": "hop", "hoping": "hope", "skies": "sky", "succeeding": "succeed", "agreed": "agre", "youth": "youth", "dog's": "dog", "analogies": "analog", "nationalization": "nation", "by": "by", "sky": "sky", "possibly": "possibl"}
    assert {w: stem(w) for w in more} == more


def test_inflected_forms_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the nation"), (2, "national nations"), (3, "notion"), (4, "connected"), (5, None)], "id long, t string")
    terms, _ = search.stored_terms(docs, ["t"], str(tmp_path / "terms"))
    groups = search.inflected([search.Group(("nations",)), search.Group(("connecting", "the nation"))], terms)
    assert [g.terms for g in groups] == [("nations", "nation", "national"), ("connecting", "the nation", "connected")]
    index = textindex.build(docs, "id", {"C": "t"}, str(tmp_path / "index"))
    assert [r["doc"] for r in textindex.top(index, groups[:1]).orderBy("rank").collect()] == [2, 1]
    assert {r["doc"] for r in textindex.top(index, groups).collect()} == {1, 2, 4}
