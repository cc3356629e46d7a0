"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts form a group that is never cut. Groups are ordered by the SHA-256
of their text; the smallest shard capacity is found by binary search over that
order, each capacity being checked by filling shards greedily, and the order is
cut where the greedy filling cuts it.

The driver never holds the groups. It holds segments of the order, those with
one prefix of the hash, with their bytes, and asks for finer segments only
where a cut falls into one that holds several groups: 4096 at first and at most
4096 more for each of the cuts in a round.

Defined results
  null text      no bytes: size 1, crc32 0; all null texts are one group
  long text      its group is not cut: the capacity is its size at least
  ties           equal hashes are one group; rows of a shard are numbered in the order of their cells
  repeated rows  each row has its own slot
  empty table    empty result
  few groups     shards without a group stay empty
  extra columns  not carried
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import written

#: Hash digits by which segments are told apart, and cells that number the rows of a shard.
DIGITS, CELLS = 3, 512
#: Rows of a cell that slots are counted in, about, and the most cells of a shard: their sums are all the driver gets.
CELL_ROWS, MOST_CELLS = 1_000_000, 1 << 16


def cells_for(rows: int, shards: int) -> int:
    """Cells of a shard: they grow with the rows, so that none of them does."""
    return min(MOST_CELLS, max(CELLS, -(-rows // (shards * CELL_ROWS))))


@dataclass(frozen=True)
class Segment:
    """Groups whose key begins with a prefix."""

    prefix: str
    size: int
    groups: int


def fill(segments: list[Segment], capacity: int) -> list[int]:
    """Where shards begin when whole segments are filled in greedily."""
    starts, held = [0], 0
    for i, s in enumerate(segments):
        if held and held + s.size > capacity:
            starts.append(i)
            held = 0
        held += s.size
    return starts


def cut_within(segments: list[Segment], capacity: int) -> set[int]:
    """Segments of several groups that a greedy filling would cut, about."""
    found, held = set(), 0
    for i, s in enumerate(segments):
        if held + s.size <= capacity:
            held += s.size
        elif s.groups > 1:
            found.add(i)
            held = (held + s.size) % capacity
        else:
            held = s.size
    return found


def minimax(segments: list[Segment], shards: int, finer: Callable[[list[Segment]], list[Segment]]) -> tuple[int, list[str]]:
    """The smallest capacity, and the first key prefix of each shard but the first.

    ``finer`` tells segments of several groups apart by longer prefixes.
    """
    segments = sorted(segments, key=lambda s: s.prefix)
    if not segments:
        return 0, []
    total = sum(s.size for s in segments)
    low, high = max(1, -(-total // shards)), total
    while True:
        mid = (low + high) // 2
        fits = max(s.size for s in segments) <= mid and len(fill(segments, mid)) <= shards
        if not fits and (within := cut_within(segments, mid)):
            # whole segments don't fit, but parts of them may
            segments = sorted([*(s for i, s in enumerate(segments) if i not in within), *finer([segments[i] for i in sorted(within)])], key=lambda s: s.prefix)
        elif low < high:
            low, high = (low, mid) if fits else (mid + 1, high)
        else:
            return high, [segments[i].prefix for i in fill(segments, high)[1:]]


def text_key(text: Column) -> Column:
    """SHA-256 of the text; a null text has a key of its own that sorts last."""
    return F.coalesce(F.sha2(text.cast("string"), 256), F.lit("g"))


def capacity_and_cuts(docs: DataFrame, text: str, shards: int) -> tuple[int, list[str]]:
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    groups = written(docs.select(text_key(F.col(text)).alias("key"), size.alias("size")).groupBy("key").agg(F.sum("size").alias("size")), "shards")

    def told(rows: DataFrame, digits: int) -> list[Segment]:
        found = rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("groups"))
        return [Segment(*r) for r in found.collect()]

    def finer(wanted: list[Segment]) -> list[Segment]:
        out = []
        for length in sorted({len(s.prefix) for s in wanted}):
            mine = [s.prefix for s in wanted if len(s.prefix) == length]
            out += told(groups.where(F.substring("key", 1, length).isin(mine)), length + DIGITS)
        return out

    return minimax(told(groups, DIGITS), shards, finer)


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    _, cuts = capacity_and_cuts(docs, text, shards)
    body, key = F.col(text), text_key(F.col(text))
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("__key") >= cut).cast("int")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(body), F.lit(0).cast("long")).alias("text_crc32"),
        key.alias("__key"),
    ).withColumn("shard", number)
    rows = written(rows.drop("__key"), "shards-rows")
    cells = cells_for(rows.count(), shards)
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    # a slot is the place within a cell after all cells before it: shards x cells sums
    sums = {(r[0], r[1]): r[2] for r in rows.groupBy("shard", "__cell").count().collect()}
    before, held = {}, {}
    for (s, c), n in sorted(sums.items()):
        before[s, c] = held.get(s, 0)
        held[s] = before[s, c] + n
    offsets = docs.sparkSession.createDataFrame([(s, c, n) for (s, c), n in before.items()], "shard int, __cell int, __before long")
    place = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("doc_id", "size"))
    return (
        rows.withColumn("__place", place)
        .join(F.broadcast(offsets), ["shard", "__cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
