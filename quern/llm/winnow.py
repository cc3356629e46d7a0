"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A text's k-grams of words are hashed, and of each ``w`` consecutive hashes the
smallest is kept with its place. Two texts that share ``k + w - 1`` words in a
row share the window that those words make, so they share its smallest hash:
with k = 5 and w = 6 no shared run of 10 words is missed. The fingerprints of
the documents are joined to those of the benchmark; each hit is extended to the
windows of 10 words around it, and these are compared word by word (as text),
so a hash collision changes nothing.

Items with fewer words than a window are one window of their own length; for
each such length every k-gram of that length is a fingerprint (w = 1). All
lengths are taken from one array of fingerprints, in one pass over the text.

Where the benchmark's fingerprints and windows are at most ``BROADCAST_ROWS``
they are broadcast: the text of a document is read once and never shuffled, its
words stay in the generated code up to the first join, and only words around
hits leave it. Beyond that, only (document, place, fingerprint) is shuffled, and
the text comes back for the documents with hits; the row that stands for a
document takes no part in a join.

Defined results
  null or empty text, no words   no words, no hits; such items are never found
  long text                      all words count; a place has 28 bits, more than the words of the longest array
  ties                           all items with a window are counted; spans that touch or overlap are one
  repeated rows                  each document row keeps its own result row
  null doc_id, null item_id      kept; a null item is not counted as an item
  equal items                    both are counted where their window occurs
  empty tables                   no documents, no rows; no items, no hits
  extra columns                  not carried
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, written

WINDOW, GRAM = 10, 5
#: Bits of a packed fingerprint that hold the place in the text; the others hold the hash.
PLACE = 28
#: A join side is broadcast only if it has at most so many rows (of about 200 bytes).
BROADCAST_ROWS = 100_000
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def winnowed(tokens: Column, k: int, w: int) -> Column:
    """Packed fingerprints: hash in the high bits, place of the gram in the low ones."""
    hashes = F.transform(tokens, lambda x: F.xxhash64(x))

    def grams(h: Column) -> Column:
        mask = F.lit(~((1 << PLACE) - 1))
        return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]).bitwiseAND(mask).bitwiseOR(i.cast("long")))

    # transform over a one-element array gives an array a name, so that it is worked out once
    kept = F.element_at(F.transform(F.array(hashes), lambda h: grams(h)), 1)
    if w == 1:
        return kept
    least = lambda g: F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, w)]))
    return F.array_distinct(F.element_at(F.transform(F.array(kept), lambda g: least(g)), 1))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, PLACE)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")


def _few(df: DataFrame) -> bool:
    """Whether a frame has so few rows that it may be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _prints(tokens: Column, kinds: list[tuple[int, int, int]]) -> Column:
    """Fingerprints (n, print, at) of all kinds: (window length n, k, w)."""

    def of(n: int, k: int, w: int) -> Column:
        return F.transform(winnowed(tokens, k, w), lambda p: F.struct(F.lit(n).alias("n"), _hash(p).alias("print"), _place(p).alias("at")))

    return F.concat(*[of(*kind) for kind in kinds])


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(n, window, item_id): every n consecutive words of an item, as text."""
    n = F.least(F.lit(window), F.size("tokens"))
    at = F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("n") + 1)).alias("at")
    cut = items.select("item_id", "tokens", n.alias("n")).select("item_id", "tokens", "n", at)
    return cut.select("n", F.concat_ws(" ", F.slice("tokens", F.col("at"), F.col("n"))).alias("window"), "item_id").distinct()


def _around(tokens: Column, n: Column, at: Column, kinds: list[tuple[int, int, int]]) -> Column:
    """The words around a hit: (n, slack, first, near); the windows that hold the gram begin up to ``slack`` words before it."""
    slack = F.element_at(F.create_map(*[F.lit(x) for kind, _, w in kinds for x in (kind, w - 1)]), n)
    first = F.greatest(at - slack, F.lit(0))
    return F.struct(n.alias("n"), slack.alias("slack"), first.alias("first"), F.slice(tokens, first + 1, n + slack).alias("near"))


def _starts(near: DataFrame) -> DataFrame:
    """(doc_id, same, whole, n_words, n, start, window): the windows around hits, and whole rows, which have none."""
    starts = F.when(F.size("x.near") >= F.col("x.n"), F.sequence(F.lit(0), F.least(F.size("x.near") - F.col("x.n"), F.col("x.slack"))))
    near = near.select("doc_id", "same", "whole", "n_words", "x", F.explode_outer(starts).alias("at")).where("whole OR at IS NOT NULL")
    return near.select("doc_id", "same", "whole", "n_words", "x.n", (F.col("x.first") + F.col("at")).alias("start"), F.concat_ws(" ", F.slice("x.near", F.col("at") + 1, F.col("x.n"))).alias("window"))


def _met(near: DataFrame, windows: DataFrame, how: str) -> DataFrame:
    """(doc_id, same, whole, n_words, n, start, item_id) of the windows that are an item's, and of whole rows."""
    windows = windows.select(F.col("n").alias("of"), F.col("window").alias("same_window"), "item_id")
    met = near.join(windows, (near.n == windows.of) & (near.window == windows.same_window), how).where("whole OR same_window IS NOT NULL")
    only = lambda c: F.when(~F.col("whole"), F.col(c)).alias(c)
    return met.select("doc_id", "same", "whole", "n_words", only("n"), only("start"), "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document row: doc_id, ``same`` (hash of its text), n_words, ``spans`` (merged hit word ranges), ``items``."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("tokens")).where(F.size("tokens") > 0)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("same"), F.col(text).alias("text"))
    lengths = [r[0] for r in items.select(F.least(F.lit(window), F.size("tokens"))).distinct().collect()]
    kinds = [(n, gram, window - gram + 1) if n == window else (n, n, 1) for n in sorted(lengths, reverse=True)] or [(window, gram, window - gram + 1)]
    own = [F.when(F.least(F.lit(window), F.size("tokens")) == kind[0], _prints(F.col("tokens"), [kind])) for kind in kinds]
    prints = written(items.select(F.explode(F.coalesce(*own)).alias("p")).select("p.n", "p.print").distinct(), "winnow-prints")
    windows = written(_windows(items, window), "winnow-windows")
    cut = docs.select("doc_id", "same", words(F.col("text")).alias("tokens"))
    if _few(prints) and _few(windows):
        # one more element per document joins the row that stands for it; nothing is shuffled here
        spark = prints.sparkSession
        marked = prints.select("n", "print", F.lit(False).alias("whole")).union(spark.createDataFrame([(0, 0, True)], "n int, print long, whole boolean"))
        stands = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("print"), F.lit(None).cast("int").alias("at"))
        found = cut.withColumn("hit", F.explode(F.concat(_prints(F.col("tokens"), kinds), F.array(stands))))
        hit = found.select("doc_id", "same", "tokens", "hit.n", "hit.print", "hit.at").join(F.broadcast(marked), ["n", "print"])
        around = F.when(~F.col("whole"), _around(F.col("tokens"), F.col("n"), F.col("at"), kinds))
        near = hit.select("doc_id", "same", "whole", F.size("tokens").alias("n_words"), around.alias("x"))
        hits = _met(_starts(near), F.broadcast(windows), "left")
    else:
        places = cut.select("doc_id", "same", F.explode(_prints(F.col("tokens"), kinds)).alias("hit")).select("doc_id", "same", "hit.n", "hit.print", "hit.at")
        places = places.join(prints, ["n", "print"], "left_semi").groupBy("doc_id", "same").agg(F.collect_set(F.struct("n", "at")).alias("hits"))
        places = written(places.select(F.col("doc_id").alias("hit_id"), F.col("same").alias("hit_same"), "hits"), "winnow-places")
        back = docs.join(F.broadcast(places) if _few(places) else places, docs.doc_id.eqNullSafe(F.col("hit_id")) & (docs.same == F.col("hit_same")))
        # words are cut once a text, and only those around hits are exploded; an outer explode, as the condition that is
        # drawn from an inner one would cut the words again for each hit
        around = F.transform("hits", lambda h: _around(F.col("tokens"), h["n"], h["at"], kinds))
        near = back.select("doc_id", "same", words(F.col("text")).alias("tokens"), "hits").select("doc_id", "same", F.lit(False).alias("whole"), F.size("tokens").alias("n_words"), F.explode_outer(around).alias("x")).where("x IS NOT NULL")
        base = cut.select("doc_id", "same", F.lit(True).alias("whole"), F.size("tokens").alias("n_words"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("start"), F.lit(None).cast(windows.schema["item_id"].dataType).alias("item_id"))
        hits = _met(_starts(near), windows, "inner").union(base)
    # one row per document row with its hits; equal rows come back as often as they came
    hits = hits.groupBy("doc_id", "same", "whole", "start", "n").agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"), F.collect_set("item_id").alias("items"))
    rows = hits.groupBy("doc_id", "same").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.max(F.when(F.col("whole"), F.col("copies"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct("start", (F.col("start") + F.col("n")).alias("end"))))).alias("starts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.aggregate(
        "starts",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda spans, s: F.when((F.size(spans) > 0) & (F.element_at(spans, -1)["end"] >= s["start"]), F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.struct(F.element_at(spans, -1)["start"].alias("start"), F.greatest(F.element_at(spans, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(spans, F.array(s))),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "same", "n_words", merged.alias("spans"), "items")


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from what :func:`decontaminate` found."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
