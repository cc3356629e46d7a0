"""Joins beyond plain equality: suffix lookups, alternatives with priority, ordinal pairing, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import suffixes
from quern.operators.versions import first_per_key

BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the frame has at most ``rows`` rows; otherwise the optimizer's own choice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def star(facts: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """Facts with their dimensions by inner equi-joins (J1); (dimension, fact key, dimension key)."""
    for dim, a, b in dims:
        facts = facts.join(dim, facts[a] == dim[b])
    return facts


def lookup(facts: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Facts with what one dimension knows of them, every fact kept."""
    return facts.join(dim.withColumnRenamed(dim_key, key) if dim_key != key else dim, key, "left")


def known(df: DataFrame, other: DataFrame, key: str, name: str = "known") -> DataFrame:
    """Whether each row's key is in another table (J4): a left join with its distinct keys."""
    keys = other.select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(keys, key, "left").withColumn(name, F.col("__hit").isNotNull()).drop("__hit")


def longest_suffix(df: DataFrame, host: str, ranks: DataFrame, ranked_host: str, value: str) -> DataFrame:
    """The value of the longest parent domain that is listed (J20, S8); null if none is."""
    hosts = df.select(host).distinct().select(host, F.posexplode(suffixes(F.col(host))).alias("__at", "__suffix"))
    found = hosts.join(ranks.select(F.col(ranked_host).alias("__suffix"), value), "__suffix").groupBy(host).agg(F.min_by(value, "__at").alias(value))
    return df.join(found, host, "left")


def without_listed(df: DataFrame, host: str, listed: DataFrame, listed_host: str, endings: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """Rows whose host, and each parent domain of it, is not listed and ends in no listed ending (F13, F14); the others, if ``keep``."""
    hosts = df.select(host).distinct()
    hit = hosts.select(host, F.explode(suffixes(F.col(host))).alias("__suffix")).join(listed.select(F.col(listed_host).alias("__suffix")), "__suffix", "left_semi").select(host)
    bad = ~F.col(host).contains(".")
    for e in endings:
        bad = bad | F.col(host).endswith(e)
    hit = hit.union(hosts.where(bad)).distinct()
    return df.join(hit, host, "left_semi" if keep else "left_anti")


def first_alternative(df: DataFrame, row: str, other: DataFrame, keys: list[tuple[str, str]], tie: str) -> DataFrame:
    """The other row that one of several keys leads to, earlier keys first.

    One equi-join per key and a choice by priority, not a join on a disjunction.
    Of the other rows with one key only the first can be chosen, so only that
    one is joined: a key of many rows on both sides never becomes all its pairs.
    """
    parts = None
    for n, (a, b) in enumerate(keys):
        whole = F.struct(*[F.col(c) for c in other.columns])
        firsts = other.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("__k")).agg(F.min_by(whole, F.struct(tie)).alias("__o")).select("__k", "__o.*")
        hit = df.where(F.col(a).isNotNull()).select(F.col(row), F.col(a).alias("__k")).join(firsts, "__k").drop("__k").withColumn("__p", F.lit(n))
        parts = hit if parts is None else parts.unionByName(hit)
    return first_per_key(parts, [row], [F.asc("__p"), F.asc(tie)]).drop("__p")


def counterpart(rows: DataFrame, group: list[str], side: str, order: str, a: str, b: str, row_id: str) -> DataFrame:
    """Each row of side a with the row of side b of the same ordinal, the last one if there are fewer."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group, side).orderBy(order, row_id)))
    left = ranked.where(F.col(side) == a)
    right = ranked.where(F.col(side) == b).select(*group, F.col("__n").alias("__m"), F.col(row_id).alias("counterpart"))
    sizes = right.groupBy(*group).agg(F.max("__m").alias("__size"))
    paired = left.join(sizes, group, "left").withColumn("__m", F.least("__n", "__size"))
    return paired.join(right, [*group, "__m"], "left").drop("__n", "__m", "__size")


def reorder(items: DataFrame, group: str, item: str, position: str, wanted: DataFrame, ordinal: str) -> DataFrame:
    """Positions after a reorder (J16): listed items by their ordinal, the others after them in their order."""
    sizes = wanted.groupBy(group).agg(F.count("*").alias("__n"))
    rows = items.join(wanted.select(group, item, ordinal), [group, item], "left").join(sizes, group, "left")
    return rows.withColumn(position, F.coalesce(F.col(ordinal).cast("long"), F.coalesce("__n", F.lit(0)) + F.col(position).cast("long"))).drop(ordinal, "__n")


def items_in_order(items: DataFrame, rows: DataFrame, item: str, row_id: str, position: str, created: str) -> DataFrame:
    """Board items with their rows by position, then age."""
    return items.join(rows, items[item] == rows[row_id]).orderBy(position, created, row_id)


def other_hosts(df: DataFrame, keys: list[str], host: str, row_id: str, chunk: int = 512) -> DataFrame:
    """Pairs of rows that agree on keys and are of different hosts.

    The pairs are as many as a group's size squared. So a group is cut into
    chunks of ``chunk`` rows or so, and each pair of chunks is a key of its own:
    a task holds some chunks, never a whole large group.
    """
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("__parts"))
    dealt = df.join(small(sizes), keys).withColumn("__own", F.pmod(F.xxhash64(host, row_id), F.col("__parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    a = dealt.select(*keys, F.col(host).alias("host_a"), F.col(row_id).alias("a"), F.col("__own").alias("__x"), each.alias("__y"))
    b = dealt.select(*keys, F.col(host).alias("host_b"), F.col(row_id).alias("b"), each.alias("__x"), F.col("__own").alias("__y"))
    return a.join(b.hint("merge"), [*keys, "__x", "__y"]).where("host_a <> host_b").drop("__x", "__y")


def trigrams(word: Column) -> Column:
    """Distinct trigrams of a word padded with two blanks before and one after (H6)."""
    padded = F.concat(F.lit("  "), F.lower(word), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(...))"), F.lit(1)))


def similar_terms(words: DataFrame, word: str, vocabulary: DataFrame, term: str, least: float = 0.3, carry: tuple[str, ...] = (), same: bool = False) -> DataFrame:
    """(word, term, similarity) of words and other terms that share enough trigrams.

    With ``same`` a word also meets itself; ``carry`` are columns of the vocabulary to keep.
    A term is one row of the vocabulary; few words are broadcast, so that terms that share nothing go at once.

    Trigrams are joined by equality and shared ones counted; the similarity is
    shared over distinct, so no two words without a common trigram are compared.
    """
    a = words.select(F.col(word).alias("word")).distinct().withColumn("g", trigrams(F.col("word")))
    b = vocabulary.select(F.col(term).alias("term"), *carry).withColumn("g", trigrams(F.col("term")))
    ga = small(a.select("word", F.size("g").alias("na"), F.explode("g").alias("gram")))
    gb = b.select("term", *carry, F.size("g").alias("nb"), F.explode("g").alias("gram"))
    met = ga.join(gb, "gram")
    shared = (met if same else met.where("word <> term")).groupBy("word", "term", *carry, "na", "nb").agg(F.count("*").alias("n"))
    scored = shared.select("word", "term", *carry, (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def gram_counts(sets: DataFrame, grams: str = "grams") -> DataFrame:
    """(gram, df): in how many sets each gram is."""
    return sets.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def by_rarity(sets: DataFrame, key: str, counts: DataFrame, grams: str = "grams", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, grams): each set, one row a key, with its grams from the rarest on; those not counted come first.

    The sets are dealt out by their key first, so where the counts are small no gram is shuffled.
    """
    each = sets.repartition(key).select(key, *carry, F.explode(grams).alias("gram")).join(small(counts), "gram", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0).cast("long")).alias("df"), "gram"))), lambda x: x["gram"])
    return each.groupBy(key, *carry).agg(ordered.alias("grams"))


def prefix(grams: Column, least: float) -> Column:
    """The grams of which two sets of that similarity must share one: all but the ``least`` part, and one more."""
    n = F.size(grams)
    return F.slice(grams, F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)


def similar_sets(a: DataFrame, a_key: str, b: DataFrame, b_key: str, least: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(a_key, b_key, similarity) of sets whose Jaccard similarity is ``least`` or more; ``carry`` are columns of b to keep.

    Both sides have ``grams`` in one order, the rarest first (:func:`by_rarity`).
    Only prefixes are joined: two sets of that similarity share a gram of their
    prefixes, and frequent grams lie beyond them. Of the pairs that meet, those of
    too different sizes go, and those whose grams behind the shared one cannot
    make up the overlap; what is left is verified, once, at the first gram that
    both have.
    """

    def met(df: DataFrame, key: str, names: tuple[str, str, str], more: tuple[str, ...] = ()) -> DataFrame:
        whole, at, out = names
        return df.select(F.col(key).alias(out), *more, F.col("grams").alias(whole), F.posexplode(prefix(F.col("grams"), least)).alias(at, "gram"))

    left, right = met(a, a_key, ("ga", "pa", "__a")), met(b, b_key, ("gb", "pb", "__b"), carry)
    na, nb = F.size("ga"), F.size("gb")
    sizes = F.least(na, nb) >= F.greatest(na, nb) * least - 1e-9
    room = 1 + F.least(na - F.col("pa"), nb - F.col("pb")) - 1 >= (na + nb) * (least / (1 + least)) - 1e-9
    both = F.array_intersect("ga", "gb")
    pairs = left.join(right, "gram").where(sizes & room).withColumn("both", both).where(F.col("both")[0] == F.col("gram"))
    similarity = F.size("both") / (na + nb - F.size("both"))
    return pairs.select(F.col("__a").alias(a_key), F.col("__b").alias(b_key), *carry, similarity.alias("similarity")).where(F.col("similarity") >= least)
