"""SimHash fingerprints and near-duplicate components by vantage-point trees.

Fingerprints link at ``radius`` or fewer differing bits. One vantage-point tree
over all 64 bits cannot be cut into shards: distances between unrelated
fingerprints gather around 32 +- 4, so a ball of radius 4 crosses nearly every
boundary. So the fingerprints are first dealt out by ``radius + 1`` disjoint
groups of bits, in one of which linked fingerprints are at distance 0, the
triangle bound of radius 0. Within such a shard a vantage-point tree over the
whole fingerprint splits by Hamming distance to a vantage point, and two sides
are only compared where their distances to it differ by ``radius`` or less.
Shards with more than ``chunk`` members are cut into chunks, and each pair of
chunks is a task of its own. The tree itself (``link``) works on any metric; the
pipeline's near-duplicates use it on sets of shingles.

A shard gives a spanning forest of its links, never all its pairs; components
come from these by alternating large-star and small-star rounds.

Defined results
  null or empty text  no words: fingerprint 0, linked like any other
  few words           the whole sequence is the one shingle
  long text           all shingles count, in pieces of 65,536
  ties                a bit that is set in exactly half the hashes is 0
  extra columns       not carried
  repeated rows       each gets its row; equal fingerprints are one node
  null doc_id         keeps its row; it never names a component unless all its ids are null
  empty table         empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, written

#: Members of a shard, or of two sides of a boundary, that are compared without another vantage point.
LEAF = 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of word shingles, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(whole[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprint_column(column, width: int = 4):
    """Fingerprint of a text column as a (signed) long."""

    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64))

    return simhash(column)


class _Forest:
    """Union-find over the members of a shard; keeps the edges that joined two trees."""

    def __init__(self, size: int):
        self.up = list(range(size))
        self.edges: list[tuple[int, int]] = []
        self.compared = 0

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            ra, rb = self.root(a), self.root(b)
            if ra != rb:
                self.up[rb] = ra
                self.edges.append((a, b))


class Bits:
    """Fingerprints at the distance of their differing bits."""

    def __init__(self, fp: np.ndarray):
        self.fp = fp

    def to(self, a: np.ndarray, vantage: int) -> np.ndarray:
        """Distance of each member of ``a`` to one member."""
        return np.bitwise_count(self.fp[a] ^ self.fp[vantage]).astype(np.int16)

    def near(self, a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
        """Whether each member of ``a`` (rows) is within the radius of each of ``b`` (columns)."""
        return np.bitwise_count(self.fp[a][:, None] ^ self.fp[b][None, :]) <= radius


def _brute(space, a: np.ndarray, b: np.ndarray, radius: float, forest: _Forest, same: bool) -> None:
    forest.compared += len(a) * (len(a) - 1) // 2 if same else len(a) * len(b)
    near = space.near(a, b, radius)
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    forest.join(zip(a[i].tolist(), b[j].tolist(), strict=True))


def link(space, a: np.ndarray, b: np.ndarray | None, radius: float, forest: _Forest) -> None:
    """Links among the members ``a`` of a metric space, or between ``a`` and ``b``, by a vantage-point tree.

    ``space`` has ``to`` and ``near`` as :class:`Bits`; its distance must keep the triangle inequality.
    """
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if not len(a) or b is not None and not len(b):
            continue
        if len(a) <= LEAF and (b is None or len(b) <= LEAF):
            _brute(space, a, a if b is None else b, radius, forest, b is None)
            continue
        vantage = int((a if b is None or len(a) >= len(b) else b)[0])
        forest.compared += len(a) + (0 if b is None else len(b))
        da = space.to(a, vantage)
        if b is None:
            # what is within the radius is linked to the vantage point and needs no comparison with each other
            within = da <= radius
            ball, inside, a, da = a[within], da[within], a[~within], da[~within]
            forest.join((vantage, x) for x in ball.tolist())
            if not len(a):
                continue
            mu = np.median(da)
            if mu == da.max():  # half of them or more are farthest
                nearer = da[da < mu]
                if not len(nearer):  # a ring of equal distances
                    for at in range(0, len(a), LEAF):
                        _brute(space, a[at : at + LEAF], a[at : at + LEAF], radius, forest, True)
                        for more in range(at + LEAF, len(a), 1024):
                            _brute(space, a[at : at + LEAF], a[more : more + 1024], radius, forest, False)
                else:
                    mu = nearer.max()
            inner, outer = da <= mu, da > mu
            if outer.any():
                # triangle bound: only what is within the radius of the boundary can link across it
                todo += [(a[inner], None), (a[outer], None), (a[inner & (da > mu - radius)], a[outer & (da <= mu + radius)])]
            rim = (inside >= da.min() - radius) & (ball != vantage)
            todo.append((ball[rim], a[da <= inside.max() + radius]))
        else:
            db = space.to(b, vantage)
            lo, hi = max(da.min(), db.min() - radius), min(da.max(), db.max() + radius)
            a, da = a[(da >= lo) & (da <= hi)], da[(da >= lo) & (da <= hi)]
            if not len(a):
                continue
            b, db = (keep := (db >= da.min() - radius) & (db <= da.max() + radius)) is not None and b[keep], db[keep]
            if len(a) > len(b):
                a, da, b, db = b, db, a, da
            # rings around the vantage point: each ring of a meets those rings of b within the radius
            for d in np.unique(da):
                ring, other = a[da == d], b[np.abs(db - d) <= radius]
                for at in range(0, len(ring), 1024):
                    for more in range(0, len(other), 1024):
                        _brute(space, ring[at : at + 1024], other[more : more + 1024], radius, forest, False)


def link_within(fp: np.ndarray, a: np.ndarray, radius: int, forest: _Forest) -> None:
    """Links among ``fp[a]`` by a vantage-point tree."""
    link(Bits(fp), a, None, radius, forest)


def _shards(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of the radius + 1 groups of bits."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(distinct: DataFrame, radius: int = 4, chunk: int = 16384) -> DataFrame:
    """(u, v): links that connect what is connected among distinct fingerprints ``fp``."""
    keys = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for k, (s, n) in enumerate(_shards(radius))]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.k", "key.v", "fp")
    # a shard with over `chunk` members is cut into chunks; each pair of chunks becomes a task key
    large = dealt.groupBy("k", "v").count().where(F.col("count") > chunk).select("k", "v", F.ceil(F.col("count") / chunk).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = (
        dealt.join(large, ["k", "v"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        .select("k", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fp: np.ndarray) -> pa.RecordBatch | None:
            if len(fp) < 2:
                return None
            forest = _Forest(len(fp))
            link_within(fp, np.arange(len(fp)), radius, forest)
            if not forest.edges:
                return None
            e = np.array(forest.edges)
            return pa.RecordBatch.from_arrays([pa.array(fp[e[:, 0]].view(np.int64)), pa.array(fp[e[:, 1]].view(np.int64))], ["u", "v"])

        rest, last = np.empty(0, np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            fps = batch.column(4).to_numpy().astype(np.int64).view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(fps)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if last is not None and (keys[a] == last).all():
                    rest = np.concatenate([rest, fps[a:b]])
                    continue
                if (out := flush(rest)) is not None:
                    yield out
                rest, last = fps[a:b], keys[a]
        if (out := flush(rest)) is not None:
            yield out

    order = ["k", "v", "x", "y"]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(linked, "u long, v long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node of the component of each node with an edge.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, the one before is deleted, and rounds end when the edges stop
    changing.
    """
    star = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    summed = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    edges = written(star(edges), label)
    before = summed(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(star(large), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges, last = written(star(small), label), edges
        dropped(last, large)
        after = summed(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: its id, ``fp`` (long) and ``component_id``, the smallest id reachable."""
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), width).alias("fp")), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
