"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (n = 1..3, lower-cased, hashed into 2^15 buckets)
of every labelled text, summed on the cluster; the driver only sees the sums,
one row per language and bucket. The matrix of log-probabilities is broadcast:
its size is ``max_langs`` x buckets x 8 bytes at most. Texts are scored in
batches of about 2^16 characters: the n-grams of a batch are a sparse matrix by
rows (texts), and its product with a language's log-probabilities is one look-up
and one sum over the rows.

Defined results
  null text, no letter  ``und`` with score 0
  empty label           null labels are not learned from; others are languages as they stand
  no labelled rows      every text is ``und`` with score 0
  many labels           all are learned; more than ``max_langs`` are an error
  long text             all of it counts, in pieces of 2^16 characters
  ties                  the language that sorts first
  repeated rows         scored alike; each counts in training
  empty table           no rows, or a model without languages
  extra columns         kept, except those named like a result column, which are replaced
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import aside

BITS, ORDERS, PIECE = 15, (1, 2, 3), 1 << 16
NONE, FACTOR = 1 << BITS, np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def batches(texts: Iterable[str], piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, buckets): the n-grams of texts, in batches of about ``piece`` characters, each order on its own.

    A batch is a sparse matrix by rows: ``rows`` are the numbers of the texts,
    ``starts`` where their buckets start. Longer texts are cut, each piece with
    the characters that its last n-grams need. Places where no n-gram begins
    hold the bucket ``NONE``.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(codes), piece):
            held.append((row, codes[at : at + piece + ORDERS[-1] - 1], min(piece, len(codes) - at)))
            size += held[-1][2]
            if size >= piece:
                yield from _grams(held)
                held, size = [], 0
    if held:
        yield from _grams(held)


def _grams(held: list[tuple[int, np.ndarray, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One sparse matrix an order, of pieces: (row, code points, how many of these begin an n-gram)."""
    codes = np.concatenate([c for _, c, _ in held]).astype(np.uint64)
    sizes, rows = np.array([len(c) for _, c, _ in held]), np.array([r for r, *_ in held])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    late = [(a + n, b) for a, b, (_, c, n) in zip(starts.tolist(), ends.tolist(), held, strict=True) if n < len(c)]
    mixed = np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        found = np.full(len(codes), NONE, np.int64)
        if (size := len(codes) - n + 1) > 0:
            mixed[:size] = n
            for i in range(n):
                np.bitwise_xor(mixed[:size], codes[i : i + size], out=mixed[:size])
                np.multiply(mixed[:size], FACTOR, out=mixed[:size])
            found[:size] = mixed[:size] >> np.uint64(64 - BITS)
        for i in range(1, n):  # these reach beyond their piece
            found[np.maximum(ends - i, starts)] = NONE
        for a, b in late:
            found[a:b] = NONE
        yield rows, starts, found


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def lettered(column: Column) -> Column:
    """Whether a text column has a letter; false for null."""

    @F.arrow_udf("boolean")
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([t.is_valid and has_letter(t.as_py()) for t in texts], pa.bool_())

    return found(column)


@dataclass
class Model:
    """Languages in order, log-probabilities of languages x buckets (0 for ``NONE``), and of languages alone."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        asked = [i for i, t in enumerate(texts) if self.langs and t is not None and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.tile(self.prior, (len(asked), 1))
        for rows, starts, found in batches(texts[i] for i in asked):
            for k, row in enumerate(self.logp):
                np.add.at(total[:, k], rows, np.add.reduceat(row[found], starts))
        if asked:
            best = total.argmax(axis=1)
            scores[asked] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k in zip(asked, best.tolist(), strict=True):
                names[i] = self.langs[k]
        return names, scores


def fit(docs: DataFrame, text: str = "text", label: str = "lang", max_langs: int = 512, smoothing: float = 0.5) -> Model:
    """Learn from all rows of ``docs`` whose label is not null; ValueError if they have over ``max_langs`` labels."""
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    seen = rows.groupBy("lang").count().limit(max_langs + 1).collect()
    if len(seen) > max_langs:
        raise ValueError(f"more than max_langs = {max_langs} labels in {label}: the model would not fit the bound, and none is left out")
    langs = sorted(r["lang"] for r in seen)
    if not langs:
        return Model([], np.empty((0, 1 << BITS)), np.empty(0))
    at = {x: i for i, x in enumerate(langs)}

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            labels = np.array([at[x] for x in batch.column(1).to_pylist()])
            order = np.argsort(labels, kind="stable")  # texts of a language beside each other
            for rows, starts, found in batches(batch.column(0)[int(i)].as_py() for i in order):
                of = labels[order[rows]]
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                for k, a, b in zip(of[cuts].tolist(), starts[cuts].tolist(), [*starts[cuts[1:]].tolist(), len(found)], strict=True):
                    row = sums.setdefault(k, np.zeros(NONE + 1, np.int64))
                    row += np.bincount(found[a:b], minlength=NONE + 1)
        for k, row in sums.items():
            used = np.flatnonzero(row[:NONE])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(row[used])], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.full((len(langs), 1 << BITS), smoothing)
    found = sums.toArrow()  # one row per language and bucket at most
    np.add.at(counts, (found["lang"].to_numpy(), found["bucket"].to_numpy()), found["n"].to_numpy().astype(float))
    prior = np.array([r["count"] for r in sorted(seen, key=lambda r: r["lang"])], float)
    logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    return Model(langs, np.hstack([logp, np.zeros((len(langs), 1))]), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            names, scores = shared.value.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    docs, back = aside(docs, "__scored")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, scored(docs[text]).alias("__scored")).select(*kept, "__scored.*").withColumnsRenamed(back)


def is_held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2 (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2
