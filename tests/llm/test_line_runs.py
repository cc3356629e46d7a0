"""Line dedup against every pair of documents: all blocks that an earlier document holds in a row."""

import random

from quern.llm import linededup
from tests.llm import brute


def left(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["sources"]) for r in linededup.dedup_lines(df).collect()}


def test_blocks_of_later_holders_go(spark):
    x, y, z = "one two three four five", "six seven eight nine", "a line of nine words that is long enough"
    got = left(spark, [(1, x), (2, y), (3, f"{x}\n{y}"), (4, f"own\n{x}\n\n{y}\nmore")])
    assert got[4] == ("own\nmore", [3]) and got[3][0] == f"{x}\n{y}"
    # the first holder has them in another order; a line comes twice
    got = left(spark, [(1, f"{y}\nmid\n{x}"), (2, f"{x}\n{y}"), (3, f"{x}\n{y}\n{z}"), (4, f"{z}\nown\n{z}\n{x}\n{y}")])
    assert {d: t for d, (t, _) in got.items()} == {1: f"{y}\nmid\n{x}", 2: f"{x}\n{y}", 3: z, 4: "own"}


def test_equal_documents_whose_lines_are_first_elsewhere(spark):
    a, b = "alpha beta gamma delta epsilon", "zeta eta theta iota kappa"
    got = left(spark, [(1, f"{a}\nx1 only here"), (2, f"{b}\ny1 only here"), (3, f"{a}\n{b}"), (4, f"{a}\n{b}")])
    assert {d: t for d, (t, _) in got.items()} == {1: f"{a}\nx1 only here", 2: f"{b}\ny1 only here", 3: f"{a}\n{b}", 4: ""}
    assert got[4][1] == [3]


def test_white_space_at_the_ends(spark):
    a = "one two three four five six seven eight nine"
    got = left(spark, [(1, a), (2, f"{a}\t\nown"), (3, f"{a}\r\n\x0b {a}\r\nown 3\r")])
    assert {d: t for d, (t, _) in got.items()} == {1: a, 2: "own", 3: "own 3\r"}


def test_long_text(spark):
    lines = [f"line {i} of a text that goes on for long" for i in range(30_000)]
    got = left(spark, [(1, "\n".join(lines)), (2, "\n".join(["first", *lines[10_000:], "last"])), (3, "x" * 3_000_000)])
    assert got[2] == ("first\nlast", [1]) and len(got[1][0]) > 900_000 and len(got[3][0]) == 3_000_000


def test_all_earlier_documents_count(spark):
    for seed in (11, 12):
        rng = random.Random(seed)
        pool = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 9]))) for _ in range(25)]
        docs = []
        for d in range(60):
            lines = [rng.choice(pool) if rng.random() < 0.6 else f"only {d} {i}" for i in range(rng.randrange(1, 14))]
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(pool) - 4)
                lines += [*pool[at : at + rng.randrange(1, 5)], *[""] * rng.randrange(2)]
            docs.append((d, "\n".join(lines)))
        want = brute.lines_left(docs)
        assert sum(t != want[d] for d, t in docs) > 20
        got = left(spark, docs)
        assert {d: t for d, (t, _) in got.items()} == want
        assert {x for t in want.values() for x in t.split("\n")} >= set(pool) & {x for _, t in docs for x in t.split("\n")}


def split(t):
    lines = [(i, x.strip(linededup.BLANKS)) for i, x in enumerate(t.split("\n"))]
    return [(n, i, x.encode(), len(x.split())) for n, (i, x) in enumerate((i, x) for i, x in lines if x)]


def random_pair(rng):
    """Texts with shared blocks, moved, repeated, cut and overlapping."""
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(12)]
    part = lambda: pool[(at := rng.randrange(11)) : at + rng.randrange(1, 6)]
    make = lambda tag: "\n".join(x for k in range(rng.randrange(1, 7)) for x in [*part(), *([f"{tag} {k}"] if rng.random() < 0.5 else []), *[""] * rng.randrange(2)])
    return make("a"), make("b")


def covered(found):
    return {i for a, b in found for i in range(a, b + 1)}


def test_repeated_alignment_finds_all_blocks():
    rng, moved = random.Random(4), 0
    for _ in range(3000):
        a, b = random_pair(rng)
        first, all_ = (covered(f(split(a), split(b), 8)) for f in (linededup.blocks, linededup.common_blocks))
        assert all_ == brute.lines_cut([(1, a), (2, b)])[2]
        moved += first < all_
    assert moved > 300  # one alignment is not enough for these


def test_only_aligned_lines_go(monkeypatch):
    rng = random.Random(4)
    pairs = [random_pair(rng) for _ in range(300)]
    assert sum(bool(linededup.common_blocks(split(a), split(b), 8)) for a, b in pairs) > 100
    monkeypatch.setattr(linededup, "patience", lambda a, b: [])
    assert not any(linededup.common_blocks(split(a), split(b), 8) for a, b in pairs)
    # an alignment that leaves out one line leaves it in the text
    monkeypatch.undo()
    whole, line = linededup.patience, b"w1 w2 w3 w4 w5 w6 w7 w8 w9"
    monkeypatch.setattr(linededup, "patience", lambda a, b: [(i, j) for i, j in whole(a, b) if b[j] != line])
    two = split(line.decode() + "\nx y z a b c d e f")
    assert covered(linededup.common_blocks(two, two, 8)) == {1}


def test_blocks_in_reverse_order():
    lines = [f"line {i} of a text with more than eight words" for i in range(5000)]
    found = linededup.common_blocks(split("\n".join(lines)), split("\n".join(lines[::-1])), 8)
    assert covered(found) == set(range(5000))


def test_holder_of_many_copies(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    docs = [(i, f"{a}\nown {i}\n{b}" if i % 3 else f"{b}\n{a}") for i in range(1200)]
    assert {d: t for d, (t, _) in left(spark, docs).items()} == {i: f"{b}\n{a}" if i == 0 else f"own {i}" if i % 3 else "" for i in range(1200)}
