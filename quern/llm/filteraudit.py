"""Filter interaction audit: what each filter removes, alone, in every subset and in every order.

Each document gets a mask with a bit for each filter that it fails, and the
documents of a part are counted by mask. A subset-zeta transform over these
counts (one round per filter, sums over all subsets of each mask) gives the
survivors of every subset of filters at once: a document survives a subset if
its mask lies within the complement. All that an order of filters does is then
a difference between neighbouring subsets: step f after the subset S removes
survivors(S) - survivors(S + f). The same transform runs over the counts of good
and of toxic documents. No document is looked at again, whatever the number of
orders.

A document fails as a copy if a smaller id in the whole table has the same text.
The smallest id of each text is found by an aggregate that combines before the
shuffle, and meets the documents by id, so a text that a third of all documents
have is no hot key.

Defined results
  null text       read as empty, and equal to it
  null part       read as the empty string
  null doc_id     not a copy, and nothing is a copy of it; counts without labels
  repeated rows   each row counts; rows with the same id and text are not copies of each other
  ties            none: copies are told by strictly smaller ids
  labels          a label counts once however often it is repeated; null labels count as 0
  long text       counts whole
  empty table     empty result
  extra columns   ignored, whatever their names
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, written

#: Measures that are counted by mask: all documents, those of quality, the toxic ones.
MEASURES = ("n", "good", "toxic")


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def standard_filters(text: Column, found: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text and its words; E (copies) needs the whole table."""
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(found) < 50,
        "B": 100 * F.size(F.array_distinct(found)) < 65 * F.size(found),
        "C": 100 * upper > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame, part: str = "source", copies: str = "E") -> tuple[DataFrame, list[str]]:
    """(doc_id, part, mask) of each document, and the names of the mask's bits from the lowest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", "text", words(F.col("text")).alias("words"))
    failed = standard_filters(F.col("text"), F.col("words"))
    names = [*failed, copies]
    mask = sum((F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)) for i, bad in enumerate(failed.values())), F.lit(0))
    # written, as the texts would be read twice otherwise: for the smallest ids and for the masks
    facts = written(rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-facts")
    firsts = facts.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = facts.where(F.col("doc_id").isNotNull()).join(firsts.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
    bit = F.lit(1 << (len(names) - 1))
    known = known.select("doc_id", "part", (F.col("mask") + F.when(F.col("first").isNull(), bit).otherwise(F.lit(0))).alias("mask"))
    masks = written(known.unionByName(facts.where(F.col("doc_id").isNull()).select("doc_id", "part", "mask")), "audit-masks")
    dropped(facts)
    return masks, names


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic)."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic")).where("quality or toxic")
    named = masks.where(F.col("doc_id").isNotNull()).join(told, "doc_id", "left").select("part", "mask", "quality", "toxic")
    both = named.unionByName(masks.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(False).alias("quality"), F.lit(False).alias("toxic")))
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic"))


def zeta(dense: Column, bits: int) -> Column:
    """Sums over all subsets: entry T of the result is the sum of the entries whose index lies within T."""

    def one_round(sums: Column, b: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), b)
        return F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(sums, i - bit)).otherwise(F.lit(0).cast("long")))

    return F.reduce(F.sequence(F.lit(0), F.lit(bits - 1)), dense, one_round)


def survivors(counts: DataFrame, bits: int) -> DataFrame:
    """(part, n, good, toxic): one row per part, arrays of the survivors of each subset of filters by its mask."""
    full = (1 << bits) - 1
    gathered = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES).alias("v")))).alias("by"))  # 2^bits entries at most
    masks = F.sequence(F.lit(0), F.lit(full))

    def dense_of(name: str) -> Column:
        return F.transform(masks, lambda m: F.coalesce(F.try_element_at("by", m)[name], F.lit(0).cast("long")))

    dense = gathered.select("part", *[dense_of(c).alias(c) for c in MEASURES])
    sums = dense.select("part", *[zeta(F.col(c), bits).alias(c) for c in MEASURES])
    # who survives S lies within its complement
    return sums.select("part", *[F.reverse(c).alias(c) for c in MEASURES])


def order_steps(alive: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the survivors of each subset."""
    bits, full = len(names), (1 << len(names)) - 1
    steps = []
    for order in permutations(range(bits)):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(names[i] for i in order), "step": k + 1, "before": before, "f": f})
            before |= 1 << f
    # times a filter stands right behind each subset, over all orders
    times = [factorial(s.bit_count()) * factorial(max(0, bits - 1 - s.bit_count())) for s in range(full + 1)]
    weights = F.array(*map(F.lit, times))
    subsets = F.sequence(F.lit(0), F.lit(full))

    def shapley(f: int) -> Column:
        gain = lambda sum_, s: sum_ + F.when(s.bitwiseAND(F.lit(1 << f)) == 0, F.get(weights, s) * (F.get("n", s) - F.get("n", s + F.lit(1 << f)))).otherwise(F.lit(0).cast("long"))
        return F.reduce(subsets, F.lit(0).cast("long"), gain)

    shares = alive.select("part", *MEASURES, F.array(*[shapley(f) for f in range(bits)]).alias("shares"))
    kind = "array<struct<filter_order: string, step: int, before: int, f: int>>"
    rows = shares.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    bit = F.call_function("shiftleft", F.lit(1), F.col("f"))
    after, rest = F.col("before") + bit, F.lit(full) - bit
    lost = lambda c: F.get(c, "before") - F.get(c, after)
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("n", after).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", bit) - lost("n")).alias("redundant"),
        (F.get("n", rest) - F.get("n", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", "f").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The steps of every order of the filters, for each part of ``docs``."""
    masks, names = marked(docs, part)
    return order_steps(survivors(mask_counts(masks, labels), len(names)), names)
