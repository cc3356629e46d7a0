"""Line dedup by pairwise alignment.

Documents overlap where they share a run: lines in a row (white space at the
ends aside) that make ``least_words`` words, taken as short as possible from
each line on and back from each line. Lines are common; runs of so many words
are rare, and any block of that many words is the union of the runs within it.
The earliest document that holds a run stands for all that hold it: each later
one is paired with it, so a run in n documents makes n - 1 pairs at most and no
run, rare or frequent, needs a cap.

Each pair is aligned with patience diff: lines that are once in either document
anchor the alignment, and the parts between anchors are aligned the same way.
Aligned lines that follow each other in both documents are a block; blocks of
``least_words`` words or more are deleted from the later document. Nothing else
is. An alignment rises in both documents, so it leaves runs that moved or come
twice: what is left of a pair (the shared runs that lie in no block yet, and
where the earlier document has them) is aligned again, ROUNDS times or as long as
that finds blocks, and after that each run with its own place in the earlier
document, until no shared run is left.

So a later document loses exactly the lines that lie in a block which any
earlier document holds in a row. The first document with a block keeps it:
whatever it is aligned with comes before it and would have to hold the block.

The later documents of one first holder meet it in parts of PART, so it is read
once for each part, and a holder of any number of copies is no hot key.

Order: by doc_id, nulls first; rows that share an id, by the hash of their text.

Defined results
  null or empty text  nothing to delete, kept as it is
  blank lines         neither align nor part a block; within a deleted block they go too
  null doc_id         first in order; not listed among sources
  ties                repeated lines are once, twice, ... in a document; each block counts on its own
  equal rows          rows with the same id and text are one document: none is later, all get the same result
  long text           all lines count; a document's shared lines are one row
  empty table         empty result
  extra columns       kept, except those named like a result column, which are replaced
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import aside, bounded_batches, dropped, written

LEAST_WORDS = 8
#: Alignments of what is left of a pair before its runs are aligned one by one.
ROUNDS = 8
#: Later documents that meet their first holder in one group.
PART = 64
#: White space that is cut from the ends of a line.
BLANKS = " \t\r\x0b\x0c"


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain that rises in both, of pairs sorted by the first."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned indexes of two sequences of hashable lines, rising in both."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        single = {x for x, n in na.items() if n == 1 and nb.get(x) == 1}
        if single:
            where = {b[j]: j for j in range(b0, b1) if b[j] in single}
            anchors = _rising([(i, where[a[i]]) for i in range(a0, a1) if a[i] in single])
        else:  # no rare line here: the n-th occurrence in one meets the n-th in the other
            nth: Counter = Counter()
            where = {}
            for j in range(b0, b1):
                nth[b[j]] += 1
                where[b[j], nth[b[j]]] = j
            nth.clear()
            pairs = []
            for i in range(a0, a1):
                nth[a[i]] += 1
                if (j := where.get((a[i], nth[a[i]]))) is not None:
                    pairs.append((i, j))
            found += _rising(pairs)
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        found += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def blocks(earlier: list[tuple[int, int, bytes, int]], later: list[tuple[int, int, bytes, int]], least_words: int) -> list[tuple[int, int]]:
    """First and last line of each block of the later document; lines are (rank, line, key, words)."""
    out, run = [], []
    for i, j in [*patience([x[2] for x in earlier], [x[2] for x in later]), (None, None)]:
        if run and (i is None or earlier[i][0] != earlier[run[-1][0]][0] + 1 or later[j][0] != later[run[-1][1]][0] + 1):
            if sum(later[k][3] for _, k in run) >= least_words:
                out.append((later[run[0][1]][1], later[run[-1][1]][1]))
            run = []
        run.append((i, j))
    return out


def _merged(cuts: Column) -> Column:
    """Sorted (start, end), overlapping and adjacent ones made one."""

    def add(done: Column, cut: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], cut["end"]).alias("end"))
        joins = (F.size(done) > 0) & (cut["start"] <= last["end"] + 1)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(cut)))

    return F.aggregate(cuts, F.array().cast("array<struct<start: int, end: int>>"), add)


def runs(lines: list[tuple[int, int, bytes, int]], least_words: int) -> list[tuple[int, int]]:
    """Positions (first, last) of the shortest runs in a row that make ``least_words`` words.

    Any block of so many words is the union of those within it. Two lines that
    are long enough alone also make a run, for the blank lines between them.
    """
    found, a, words = set(), 0, 0
    for b, (rank, _, _, n) in enumerate(lines):
        if b and rank != lines[b - 1][0] + 1:
            a, words = b, 0
        words += n
        # a run from each a on, ended by b
        while a <= b and words >= least_words:
            found.add((a, b))
            words -= lines[a][3]
            a += 1
    b, words = len(lines) - 1, 0
    for a in range(len(lines) - 1, -1, -1):
        if a + 1 < len(lines) and lines[a][0] + 1 != lines[a + 1][0]:
            b, words = a, 0
        words += lines[a][3]
        # and one back from each b, begun by a
        while a <= b and words >= least_words:
            found.add((a, b))
            words -= lines[b][3]
            b -= 1
    for a in range(len(lines) - 1):
        if lines[a][0] + 1 == lines[a + 1][0] and min(lines[a][3], lines[a + 1][3]) >= least_words:
            found.add((a, a + 1))
    return sorted(found)


def _sequences(column: pa.Array) -> Iterator[list[tuple[int, int, bytes, int]]]:
    """The (rank, line, key, words) of each row's lines."""
    flat = column.flatten()
    fields = [flat.field(name).to_pylist() for name in ("rank", "line", "key", "words")]
    at = 0
    for n in pc.list_value_length(column).to_pylist():
        yield list(zip(*(f[at : at + n] for f in fields), strict=True))
        at += n


def _key(lines: list[tuple[int, int, bytes, int]], a: int, b: int) -> bytes:
    return md5(b"".join(x[2] for x in lines[a : b + 1])).digest()


def places_of(lines: list[tuple[int, int, bytes, int]], least_words: int) -> dict[bytes, tuple[int, int]]:
    """Where each run of a document stands first."""
    found: dict[bytes, tuple[int, int]] = {}
    for a, b in runs(lines, least_words):
        found.setdefault(_key(lines, a, b), (a, b))
    return found


def _outside(shared: list, found: list[tuple[int, int]], later: list[tuple[int, int, bytes, int]]) -> list:
    """The shared runs that lie in none of the blocks."""
    ordered = sorted(found)
    starts, ends = [a for a, _ in ordered], [b for _, b in ordered]
    for k in range(1, len(ends)):
        ends[k] = max(ends[k], ends[k - 1])

    def inside(run: tuple[int, int]) -> bool:
        at = bisect_right(starts, later[run[0]][1]) - 1
        return at >= 0 and later[run[1]][1] <= ends[at]

    return [x for x in shared if not inside(x[0])]


def common_blocks(earlier: list[tuple[int, int, bytes, int]], later: list[tuple[int, int, bytes, int]], least_words: int, places: dict[bytes, tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """First and last line of the aligned blocks that hold all runs of the later document which the earlier one has.

    ``places`` may give the earlier document's runs, to save working them out again.
    """
    places = places if places is not None else places_of(earlier, least_words)
    found = blocks(earlier, later, least_words)
    shared = [((a, b), place) for a, b in runs(later, least_words) if (place := places.get(_key(later, a, b)))]
    left = _outside(shared, found, later)
    for _ in range(ROUNDS):
        if not left:
            break
        mine, theirs = ([lines[i] for i in sorted({i for x in left for i in range(x[k][0], x[k][1] + 1)})] for k, lines in ((0, later), (1, earlier)))
        more = blocks(theirs, mine, least_words)
        found += more
        rest = _outside(left, more, later)
        if len(rest) == len(left):
            break
        left = rest
    for (a, b), (c, d) in left:
        found += blocks(earlier[c : d + 1], later[a : b + 1], least_words)
    return found


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the text that is left, and ``n_lines``, ``n_removed`` and ``sources`` (ids of the earlier documents)."""
    bounded_batches(docs.sparkSession, rows=500, size=8 << 20)
    docs, back = aside(docs, "__me", "__text", "__cuts", "__sources", "__left")
    me = F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    line = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("body"))), lambda x: x["body"] != "")
    lines = (
        docs.where(F.col(text).isNotNull())
        .select(me.alias("me"), F.posexplode(line).alias("rank", "x"))
        .select("me", "rank", "x.line", F.unhex(F.md5("x.body")).alias("key"), F.regexp_count("x.body", F.lit(r"\S+")).alias("words"))
    )
    lines = written(lines, "lines")
    # written, so that the join below has the frequent lines in an exchange of their own, which can be split
    shared = written(lines.groupBy("key").agg(F.min("me").alias("first"), F.max("me").alias("last")).where("first < last").select("key"), "lines-shared")
    # a document's lines that another one has too; written, for the join by first holder: some are paired with many
    held = lines.join(shared, "key").groupBy("me").agg(F.sort_array(F.collect_set(F.struct("rank", "line", "key", "words"))).alias("lines"))
    sequences = written(held, "lines-sequences")
    dropped(lines, shared)

    def in_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[*{_key(rows, a, b) for a, b in runs(rows, least_words)}] for rows in _sequences(batch.column(1))]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [*map(len, keys)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([k for ks in keys for k in ks], pa.binary())], ["me", "key"])

    held_runs = written(sequences.mapInArrow(in_row, "me struct<id: long, h: long>, key binary"), "lines-runs")
    firsts = written(held_runs.groupBy("key").agg(F.min("me").alias("first"), F.max("me").alias("last")).where("first < last").select("key", "first"), "lines-first")
    pairs = written(held_runs.join(firsts, "key").where("first < me").select("first", "me").distinct(), "lines-pairs")
    # written, so that both sides of the joins have exchanges of their own, which can be split
    hot = written(pairs.groupBy("first").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"), "lines-hot")
    dropped(held_runs, firsts)
    parts = F.coalesce("parts", F.lit(1))
    placed = written(pairs.join(hot, "first", "left").select("first", "me", F.pmod(F.xxhash64("me"), parts).cast("int").alias("part")), "lines-placed")
    later = placed.join(sequences, "me").select("first", "part", "me", "lines")
    # the first holder goes to each of its parts, as a row that is its own first
    holders = placed.select("first", "part").distinct().join(sequences.select(F.col("me").alias("first"), "lines"), "first").select("first", "part", F.col("first").alias("me"), "lines")
    together = later.unionByName(holders).repartition("first", "part").sortWithinPartitions("first", "part", "me")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, earlier, places = None, [], {}
        for batch in batches:
            out = {"me": [], "source": [], "start": [], "end": []}
            for n, (holder, me, lines) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sequences(batch.column(2)), strict=True)):
                if holder == me:  # sorted before all that are paired with it
                    if holder != first:
                        first, earlier, places = holder, lines, places_of(lines, least_words)
                    continue
                for a, b in common_blocks(earlier, lines, least_words, places):
                    for name, value in zip(out, (n, holder["id"], a, b), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(out["me"], pa.int32())), *(pa.array(out[c], t) for c, t in (("source", pa.int64()), ("start", pa.int32()), ("end", pa.int32())))], [*out])

    cuts = together.select("first", "me", "lines").mapInArrow(align, "me struct<id: long, h: long>, source long, start int, end int")
    cuts = cuts.groupBy(F.col("me").alias("__me")).agg(_merged(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("__cuts"), F.array_sort(F.collect_set("source")).alias("__sources"))
    cuts = written(cuts, "lines-cuts")
    dropped(sequences, pairs, hot, placed)
    kept_columns = [c for c in docs.columns if c not in (text, "n_lines", "n_removed", "sources")]
    whole = F.split(F.col("__text"), "\n")
    left = F.filter(whole, lambda _, i: ~F.exists("__cuts", lambda c: (i >= c["start"]) & (i <= c["end"])))
    out = docs.select(*kept_columns, F.col(text).alias("__text"), me.alias("__me")).join(cuts, "__me", "left")
    out = out.withColumn("__left", F.when(F.col("__cuts").isNotNull(), left))
    out = out.select(
        *kept_columns,
        F.when(F.col("__left").isNotNull(), F.array_join("__left", "\n")).otherwise(F.col("__text")).alias(text),
        F.coalesce(F.size(whole), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(whole) - F.size("__left"), F.lit(0)).alias("n_removed"),
        F.coalesce("__sources", F.array().cast("array<long>")).alias("sources"),
    )
    return out.select(*[c for c in docs.columns if c in kept_columns or c == text], "n_lines", "n_removed", "sources").withColumnsRenamed(back)
