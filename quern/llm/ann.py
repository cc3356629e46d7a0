"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample: a sixteenth of the rows, between
``SAMPLE[0]`` and ``SAMPLE[1]``, so leaves grow in number with the rows up to
that bound. Every row is then put into the leaf that its nearest centroids lead
to. A query walks the tree with a priority queue that holds, for each open
branch, the inner product that its better rows have (that of the centroid plus
``SPREAD`` deviations of the branch), and takes leaves in that order. How many
leaves are visited is calibrated: for ``calibration`` queries the true
neighbours are found among all rows, and visits are widened until ``recall`` of
them lies in the visited leaves.

Rows travel by cell, a branch of the tree with many leaves; a query goes to a
cell once, with the list of leaves it visits there. Cells of any size are cut
into chunks, of rows and of queries, and each pair of chunks is one task; a cell
that holds a third of all rows is so many tasks. What a task finds is k rows a
query, scored again on the original vectors in double precision.

Defined results
  null, zero, holding null or non-finite components   take no part, as rows and as queries
  other lengths    vectors not of the most frequent length (ties: the longer) take no part
  ties             smaller vec_id first
  repeated rows    equal rows are one query, whose own row is one of them; the others are candidates
  repeated ids     rows of one id with different vectors are queries of their own, and candidates to each other
  null vec_id      a candidate, after all other ids among ties; never a query
  few rows         all candidates, if fewer than k
  empty table      empty result
  extra columns    not carried
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import bounded_batches, written

SAMPLE, BRANCH, LEAF, CELL, CALIBRATION = (20_000, 200_000), 8, 16, 1024, 256
CHUNK_ROWS, CHUNK_QUERIES, BLOCK = 16_384, 4_096, 128
#: Deviations, along a query, by which the better rows of a branch lie beyond its centroid.
SPREAD = 3.0


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf has no children."""

    centroids: np.ndarray
    spreads: np.ndarray
    children: list[list[int]]
    leaf_of: np.ndarray
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    @property
    def leaves(self) -> int:
        return len(self.cells)

    @staticmethod
    def fit(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, cell: int = CELL, seed: int = 0) -> Tree:
        rng = np.random.default_rng(seed)
        centroids, spreads, children, leaf_of, cells = [], [], [], [], []
        todo, n_cells = [(x, -1, -1)], 0
        while todo:
            rows, parent, inside = todo.pop()
            me = len(centroids)
            if parent >= 0:
                children[parent].append(me)
            center = rows.mean(axis=0)
            centroids.append(center)
            spreads.append(float(np.sqrt(((rows - center) ** 2).mean())))
            children.append([])
            leaf_of.append(-1)
            if inside < 0 and len(rows) <= cell:
                inside, n_cells = n_cells, n_cells + 1
            label = kmeans(rows, branch, rng) if len(rows) > leaf else np.zeros(len(rows), int)
            parts = [rows[label == k] for k in np.unique(label)]
            if len(parts) > 1:
                todo += [(p, me, inside) for p in parts]
            else:
                if inside < 0:
                    inside, n_cells = n_cells, n_cells + 1
                leaf_of[me] = len(cells)
                cells.append(inside)
        return Tree(np.stack(centroids), np.array(spreads), children, np.array(leaf_of, np.int32), np.array(cells, np.int32))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            kids = np.array(self.children[at], int)
            if not len(kids):
                out[rows] = self.leaf_of[at]
                continue
            centers = self.centroids[kids]
            near = ((centers**2).sum(axis=1)[None, :] - 2 * x[rows] @ centers.T).argmin(axis=1)
            todo += [(int(c), rows[near == k]) for k, c in enumerate(kids) if (near == k).any()]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query the leaves in best-bin-first order, ``most`` of them."""
        out = []
        for at in range(0, len(q), 64):
            some = q[at : at + 64]
            promise = -(some @ self.centroids.T + SPREAD * np.sqrt((some**2).sum(axis=1))[:, None] * self.spreads)
            for keys in promise.tolist():
                order, queue = [], [(keys[0], 0)]
                while queue and len(order) < most:
                    _, node = heapq.heappop(queue)
                    if kids := self.children[node]:
                        for c in kids:
                            heapq.heappush(queue, (keys[c], c))
                    else:
                        order.append(int(self.leaf_of[node]))
                out.append(order)
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = ((centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T).argmin(axis=1)
        centers = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(k)])
    return label


def vectors(rows: pa.Array, dim: int) -> np.ndarray:
    flat = rows.combine_chunks().flatten() if isinstance(rows, pa.ChunkedArray) else rows.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def best(q: np.ndarray, ids: np.ndarray, nameless: np.ndarray, x: np.ndarray, k: int, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows; ``rough`` are their products up to rounding, -inf for those left out."""
    top = np.argpartition(rough, -k)[-k:] if len(rough) > k else np.arange(len(rough))
    kth = rough[top].min()
    if len(rough) > k and kth > -np.inf:
        slack = 1e-12 * len(q) * (1 + np.sqrt(q @ q) * np.sqrt((x[top] ** 2).sum(axis=1).max()) + abs(kth))
        top = np.flatnonzero(rough >= kth - slack)
    else:
        top = np.flatnonzero(rough > -np.inf)
    exact = (x[top] * q).sum(axis=1)
    order = np.lexsort((ids[top], nameless[top], -exact))[:k]
    return top[order], exact[order]


def found_in(q: np.ndarray, own: np.ndarray, visits: list[np.ndarray], ids: np.ndarray, nameless: np.ndarray, x: np.ndarray, leaf: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of the k best rows among the visited leaves; one row equal to the query is its own."""
    order = np.argsort(leaf, kind="stable")
    ids, nameless, x, leaf = ids[order], nameless[order], x[order], leaf[order]
    cuts = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1, append=leaf[-1] + 1))
    names = leaf[cuts[:-1]]
    for at in range(0, len(q), BLOCK):
        some = q[at : at + BLOCK]
        rough = np.full((len(some), len(x)), -np.inf)
        asked = np.zeros((len(some), len(names)), bool)
        for i in range(len(some)):
            asked[i] = np.isin(names, visits[at + i])
        for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if len(who := np.flatnonzero(asked[:, j])):
                rough[who, a:b] = some[who] @ x[a:b].T
        for i, row in enumerate(rough):
            same = np.flatnonzero((ids == own[at + i]) & ~nameless)
            same = same[(x[same] == some[i]).all(axis=1)]
            row[same[:1]] = -np.inf
            places, scores = best(some[i], ids, nameless, x, k, row)
            if len(places):
                yield at + i, order[places], scores


def search(embeddings: DataFrame, queries: Column | None = None, k: int = 20, recall: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", sample: tuple[int, int] = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row.

    ``queries`` is a condition on ``vec_id`` (default: divisible by 20).
    """
    spark = embeddings.sparkSession
    bounded_batches(spark, rows=4000, size=16 << 20)
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["n"]
    rows = rows.where(F.size("v") == dim)
    asked = queries if queries is not None else F.col("vec_id") % 20 == 0

    drawn = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(min(max(sample[0], lengths["count"] // 16), sample[1])).select("v").toArrow()
    tree = Tree.fit(vectors(drawn["v"], dim))
    shared = spark.sparkContext.broadcast(tree)
    tasks = spark.sparkContext.defaultParallelism

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(vectors(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(shared.value.cells[leaf])], ["vec_id", "v", "leaf", "cell"])

    index = written(rows.mapInArrow(assign, "vec_id long, v array<double>, leaf int, cell int"), "ann-index")
    # dealt out with a number: these rows are few, but each has a walk through the tree to do
    wanted = written(index.where(asked & F.col("vec_id").isNotNull()).select("vec_id", "v").distinct().repartition(tasks, "vec_id", F.xxhash64("v")), "ann-queries")
    visits = _visits(index, wanted, shared, dim, k, recall, calibration)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value.cells
        for batch in batches:
            at, cell, leaves = [], [], []
            for i, found in enumerate(shared.value.visit(vectors(batch.column(1), dim), visits)):
                found = np.sort(np.array(found, np.int32))
                of = cells[found]
                for c in np.unique(of):
                    at.append(i)
                    cell.append(c)
                    leaves.append(found[of == c])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), batch.column(1).take(pa.array(at, pa.int32())), pa.array(cell, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["query_id", "q", "cell", "leaves"])

    probes = written(wanted.mapInArrow(probe, "query_id long, q array<double>, cell int, leaves array<int>"), "ann-probes")
    # chunks by cell: one row per cell, of which the sample bounds the number
    sizes = index.groupBy("cell").count().collect()
    asked_of = dict(probes.groupBy("cell").count().collect())
    parts = spark.createDataFrame([(r["cell"], -(-r["count"] // CHUNK_ROWS), max(1, -(-asked_of.get(r["cell"], 0) // CHUNK_QUERIES))) for r in sizes], "cell int, nr int, nq int")
    cut = lambda df, own, n, other, m: df.join(F.broadcast(parts), "cell").withColumn(own, F.pmod(F.xxhash64(df.columns[0], df.columns[1]), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("nr", "nq")
    left = cut(probes, "b", "nq", "a", "nr").groupBy("cell", "a", "b")
    right = cut(index, "a", "nr", "b", "nq").groupBy("cell", "a", "b")

    def scan(qs: pa.Table, xs: pa.Table) -> pa.Table:
        out = [[np.empty(0, t)] for t in (np.int64, np.int64, np.int64, float)]
        if qs.num_rows and xs.num_rows:
            x, ids, nameless = vectors(xs["v"], dim), xs["vec_id"].fill_null(0).to_numpy(), xs["vec_id"].is_null().to_numpy()
            q, own = vectors(qs["q"], dim), qs["query_id"].to_numpy()
            leaves = qs["leaves"].combine_chunks() if isinstance(qs["leaves"], pa.ChunkedArray) else qs["leaves"]
            for i, places, scores in found_in(q, own, [np.asarray(v.values) for v in leaves], ids, nameless, x, xs["leaf"].to_numpy(), k):
                for col, values in zip(out, (np.full(len(places), own[i]), np.full(len(places), zlib.crc32(q[i].tobytes())), places, scores), strict=True):
                    col.append(values)
        query, same, places, scores = map(np.concatenate, out)
        return pa.table({"query_id": query, "same": same, "vec_id": xs["vec_id"].take(pa.array(places)) if len(places) else pa.array([], pa.int64()), "score": scores})

    found = left.cogroup(right).applyInArrow(scan, "query_id long, same long, vec_id long, score double")
    order = Window.partitionBy("query_id", "same").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visits(index: DataFrame, wanted: DataFrame, shared, dim: int, k: int, recall: float, calibration: int) -> int:
    """The number of leaves to visit, calibrated against all rows."""
    tree: Tree = shared.value
    drawn = wanted.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration).toArrow()
    if not drawn.num_rows:
        return tree.leaves
    q, own = vectors(drawn["v"], dim), drawn["vec_id"].to_numpy()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, int, int]]] = [[] for _ in q]
        for batch in batches:
            ids, x, leaf = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), vectors(batch.column(1), dim), batch.column(2).to_numpy()
            for at in range(0, len(ids), 4096):
                rough = q @ x[at : at + 4096].T
                for i, row in enumerate(rough):
                    row = np.where((ids[at : at + 4096] == own[i]) & (x[at : at + 4096] == q[i]).all(axis=1), -np.inf, row)
                    top = np.argpartition(row, -min(k, len(row)))[-min(k, len(row)) :]
                    new = [(float(row[j]), int(ids[at + j]), int(leaf[at + j])) for j in top if row[j] > -np.inf]
                    held[i] = sorted(held[i] + new, key=lambda t: (-t[0], t[1]))[:k]
        flat = [(i, s, v, leaf) for i, h in enumerate(held) for s, v, leaf in h]
        cols = [*zip(*flat, strict=True)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["i", "score", "vec_id", "leaf"])

    order = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    truth = index.mapInArrow(exact, "i int, score double, vec_id long, leaf int").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "leaf").collect()
    places = [{leaf: n for n, leaf in enumerate(found, 1)} for found in tree.visit(q, tree.leaves)]
    needed = sorted(places[r["i"]][r["leaf"]] for r in truth)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else tree.leaves
