"""Source divergence audit: how far the words of each source lie from those of the others of its language.

Terms are counted per language and source; a language keeps those that enough of
its documents hold. With a count c, a group's mass of a term is
p = 1 + floor(SCALE * (c + 1) / (N + V)), and one pair of sources differs by the
sum over all kept terms of f(p, q) = floor((p - q)^2 / q). That sum never goes
through terms: for each pair of sources the distinct (count, count) combinations
are tallied, f is evaluated once per combination and taken as often as the
combination occurs. Cells where both counts are above zero come from the terms;
those with a zero are implied by the two sources' own histograms, and (0, 0) is
what is left of V.

    pairs of a term    made and tallied within a task, sources in blocks of
                       BLOCK, and only tallies are shuffled
    zero cells         signed rows: a combination (a, b) takes one from (a, 0)
                       and (0, b) and gives one to (0, 0)

All arithmetic is in whole numbers. A value fits a long as long as the masses of
a group sum up to less than 3 * 10^9, that is for up to 2 * 10^9 kept terms.

Defined results
  null text, lang, source   read as the empty string
  null doc_id               no matter: ids are not used
  repeated rows             each row is a document and counts
  no kept terms             the value of each pair is 0; no term rows
  ties                      by the item, in the order of its UTF-8 bytes
  a single source           no pair rows
  long text                 counts whole
  empty table               empty result
  extra columns             ignored, whatever their names
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import ascii_lower, dropped, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Sources of a language that meet in one task; more are cut into blocks, each pair of blocks on its own.
BLOCK = 64
#: Tallies that a task holds before it hands them on, and rows it looks at together.
HELD, ROWS = 400_000, 100_000
#: Groups (language and source) that are broadcast; beyond, joins shuffle.
BROADCAST_GROUPS = 50_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    terms = docs.select(read("lang"), read("source"), F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(TERM), F.lit(0)).alias("terms"))
    # once with all occurrences, once with each term of the text: both are counted in one pass
    both = terms.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    rows = both.select("lang", "source", "once", F.explode("terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.count_if(F.col("once") == 0).alias("n"), F.count_if(F.col("once") == 1).alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, head): counts of kept terms with the language's; ``head`` marks one row per term."""
    term = Window.partitionBy("lang", "term")
    sums = counts.select("*", F.sum("docs").over(term).alias("all_docs"), F.sum("n").over(term).alias("total"), F.row_number().over(term.orderBy("source")).alias("k"))
    return sums.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "total", (F.col("k") == 1).alias("head"))


def group_sizes(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, no, n_group, n_lang, v, groups) of every occurring group; ``no`` counts from 0 within the language."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(read("lang"), read("source")).groupBy("lang", "source").agg(F.count("*").alias("rows"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = cells.where("head").groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    lang = Window.partitionBy("lang")
    found = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return found.select("lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).alias("no"), zero("n_group"), zero("n_lang"), zero("v"), F.count("*").over(lang).cast("int").alias("groups"))


def mass(count: Column, total: Column, v: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (total + v)), exactly."""
    top = F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", top, (total + v).cast("decimal(20,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(table: pa.Table, block: int) -> pa.Table:
    """The tallies (lang, a, b, na, nb, m) of whole terms; rows are sorted by lang, x, y, term and no."""
    names = table.column("lang").combine_chunks().dictionary_encode()
    lang, no, n, x, y = (np.asarray(c) for c in (names.indices, table["no"], table["n"], table["x"], table["y"]))
    group = np.cumsum(_starts(table))
    found = []
    for d in range(1, 2 * block):
        left = np.nonzero(group[d:] == group[:-d])[0]
        if not len(left):
            break
        right = left + d
        ok = (x[left] == y[left]) | (no[left] // block != no[right] // block)
        left, right = left[ok], right[ok]
        found.append((lang[left], no[left], no[right], n[left], n[right]))
    if not found:
        return SCHEMA.empty_table()
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    made = pa.table(dict(zip(("code", "a", "b", "na", "nb"), columns, strict=True))).group_by(["code", "a", "b", "na", "nb"], use_threads=False).aggregate([([], "count_all")])
    return pa.table([names.dictionary.take(made["code"].combine_chunks()), made["a"], made["b"], made["na"], made["nb"], made["count_all"]], schema=SCHEMA)


SCHEMA = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("na", pa.int64()), ("nb", pa.int64()), ("m", pa.int64())])


def _starts(table: pa.Table) -> np.ndarray:
    """Whether each row begins a new term."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("lang", "x", "y", "term"):
        values = table[c].combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(values[1:], values[:-1]))
    return new


def tallying(block: int = BLOCK, most: int = HELD, together: int = ROWS):
    """What a task does with its terms: tallies are held, merged and, where still more than half of ``most``, handed on."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["lang", "a", "b", "na", "nb"], use_threads=False).aggregate([("m", "sum")])
        return pa.table([sums[c] for c in ("lang", "a", "b", "na", "nb", "m_sum")], schema=SCHEMA)

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rows, held, size = [], 0, [], 0
        for batch in _and_end(batches):
            if batch is not None:
                rest.append(pa.Table.from_batches([batch]))
                rows += batch.num_rows
                if rows < together:
                    continue
            if not rows:
                continue
            table = pa.concat_tables(rest)
            # the last term may go on in the next batch
            end = table.num_rows if batch is None else int(np.nonzero(_starts(table))[0][-1])
            rest, rows = [table.slice(end)], table.num_rows - end
            if end:
                held.append(_pairs(table.slice(0, end), block))
                size += held[-1].num_rows
            if size > most:
                held = [merged(held)]
                size = held[0].num_rows
                if size > most // 2:
                    yield from held[0].to_batches(max_chunksize=20_000)
                    held, size = [], 0
        if held:
            yield from merged(held).to_batches(max_chunksize=20_000)

    return tallied


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def joint_counts(cells: DataFrame, groups: DataFrame, block: int = BLOCK, most: int = HELD, together: int = ROWS) -> DataFrame:
    """(lang, a, b, na, nb, m), a < b: how many kept terms have these two counts above zero, added up by task."""
    blocks = F.ceil(F.col("groups") / block).cast("int")
    own = F.floor(F.col("no") / block).cast("int")
    placed = cells.join(_small(groups.select("lang", "source", "no", "groups")), ["lang", "source"])
    dealt = placed.select("lang", "term", "no", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    order = ["lang", "x", "y", "term"]
    dealt = dealt.select("lang", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "term", "no", "n")
    return dealt.repartition(*order).sortWithinPartitions(*order, "no").mapInArrow(tallying(block, most, together), "lang string, a int, b int, na long, nb long, m long")


def _small(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def histograms(joint: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, m): the whole histogram of each pair of sources, zero cells included; the m of a pair sum up to V."""
    row = lambda na, nb, m: F.struct(na.alias("na"), nb.alias("nb"), m.alias("m"))
    zero, m = F.lit(0).cast("long"), F.col("m")
    na, nb = F.col("na"), F.col("nb")
    seen = joint.select("lang", "a", "b", F.inline(F.array(row(na, nb, m), row(na, zero, -m), row(zero, nb, -m), row(zero, zero, m))))
    ids = _small(groups.select("lang", "source", "no"))
    own = cells.join(ids, ["lang", "source"]).groupBy("lang", "no", "n").agg(F.count("*").alias("m"))
    others = own.join(_small(groups.select("lang", F.col("no").alias("other"))), "lang").where("no <> other")
    first = F.col("no") < F.col("other")
    mine = others.select(
        "lang",
        F.least("no", "other").alias("a"),
        F.greatest("no", "other").alias("b"),
        F.inline(F.array(row(F.when(first, F.col("n")).otherwise(zero), F.when(first, zero).otherwise(F.col("n")), m), row(zero, zero, -m))),
    )
    a, b = groups.select("lang", F.col("no").alias("a"), F.col("v").alias("m")), groups.select("lang", F.col("no").alias("b"))
    base = a.join(_small(b), "lang").where("a < b").select("lang", "a", "b", zero.alias("na"), zero.alias("nb"), "m")
    return seen.unionByName(mine).unionByName(base).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m")).where("m <> 0")


def pair_values(tallies: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language."""
    a = _small(groups.select("lang", F.col("no").alias("a"), F.col("source").alias("source_a"), F.col("n_group").alias("total_a"), "v"))
    b = _small(groups.select("lang", F.col("no").alias("b"), F.col("source").alias("source_b"), F.col("n_group").alias("total_b")))
    named = tallies.join(a, ["lang", "a"]).join(b, ["lang", "b"])
    masses = named.select("lang", "source_a", "source_b", "m", mass(F.col("na"), F.col("total_a"), F.col("v")).alias("p"), mass(F.col("nb"), F.col("total_b"), F.col("v")).alias("q"))
    there, back = distance(F.col("p"), F.col("q")) * F.col("m"), distance(F.col("q"), F.col("p")) * F.col("m")
    sums = masses.groupBy("lang", "source_a", "source_b").agg(F.sum(there).alias("there"), F.sum(back).alias("back"))
    side = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("value"))
    found = sums.select("lang", F.inline(F.array(side("source_a", "source_b", "there"), side("source_b", "source_a", "back"))))
    all_pairs = groups.select("lang", "source").join(_small(groups.select("lang", F.col("source").alias("item"))), "lang").where("source <> item")
    known = all_pairs.join(found, ["lang", "source", "item"], "left")
    return known.select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def term_values(cells: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group has more of than its language, the first ``top``."""
    sized = cells.where("n > 0").join(_small(groups), ["lang", "source"])
    masses = sized.select("lang", "source", F.col("term").alias("item"), mass(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), mass(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    more = masses.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    return more.withColumn("rank", F.row_number().over(_ranks())).where(F.col("rank") <= top)


def _ranks():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for the other sources, part ``term`` for the group's own terms."""
    counts = written(term_counts(docs), "divergence-counts")
    cells = written(kept_terms(counts, least_docs), "divergence-cells")
    dropped(counts)
    groups = written(group_sizes(docs, cells), "divergence-groups")
    tallies = written(histograms(joint_counts(cells, groups), cells, groups), "divergence-tallies")
    pairs = pair_values(tallies, groups).withColumn("rank", F.row_number().over(_ranks()))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(term_values(cells, groups, top).withColumn("part", F.lit("term")).select(columns))
