"""Hybrid search: reading a query, typo expansion, text and vector candidates, and rank fusion.

A query is read on the driver, where it is a dozen words; everything that
touches the corpus is a DataFrame. Filters go into each candidate list before
its limit, so a candidate is always a result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import fixed
from quern.functions.stems import stem, stems
from quern.operators.joins import by_rarity, gram_counts, similar_sets, similar_terms, trigrams
from quern.sources import commits

# Sizes of the search.
MAX_WORDS, CANDIDATES, FUSION, LEAST_SIMILARITY = 12, 200, 60, 0.3
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
# Weights of fields A, B and C in a text rank.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


@dataclass(frozen=True)
class Group:
    """Terms, or phrases of several words, of which one has to match."""

    terms: tuple[str, ...]
    weight: int = 1


# -- reading a query (H1-H4) --


def query_words(q: str) -> list[str]:
    """Distinct words in order, without marks, the first twelve."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", q.lower()) if not unicodedata.combining(c))
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+(?:'[a-z]+)?", plain)))[:MAX_WORDS]


def max_edits(word: str) -> int:
    return 2 if len(word) >= 8 else 1


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is at most ``most``: only a band of that width is filled in."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        band = range(max(0, i - most), min(len(b), i + most) + 1)
        row = _next_row(row, i, x, b, band, far)
        if min(row.values()) > most:
            return False
    return row.get(len(b), far) <= most


def _next_row(up: dict[int, int], i: int, x: str, b: str, band: range, far: int) -> dict[int, int]:
    row: dict[int, int] = {}
    for j in band:
        row[j] = i if j == 0 else min(up.get(j, far) + 1, row.get(j - 1, far) + 1, up.get(j - 1, far) + (x != b[j - 1]))
    return row


def same_word(typed: str, word: str) -> bool:
    """Equal, a plural or singular, or a typo of a word of four letters or more."""
    if typed in (word, word + "s") or typed + "s" == word:
        return True
    return len(typed) >= 4 and within_edits(typed, word, max_edits(word))


def intents(words: list[str], kinds: dict = fixed.KIND_PHRASES, aliases: dict = fixed.KIND_ALIASES) -> dict[str, list[str]]:
    """Kinds a query names, with the words it used; longer names first, a word counts once (A.5)."""
    names = [(k, tuple(p for p in k.split("-") if p != "and")) for k in kinds]
    names += [(k, parts) for k, list_ in aliases.items() if k in kinds for parts in list_]
    free, found = dict(enumerate(words)), {}
    for kind, parts in sorted(names, key=lambda n: (-len(n[1]), n[0])):
        left, taken = dict(free), []
        for part in parts:
            at = next((i for i, w in left.items() if same_word(w, part)), None)
            if at is None:
                break
            taken.append(at)
            del left[at]
        else:
            free = left
            found.setdefault(kind, []).extend(taken)
    return {k: [words[i] for i in sorted(at)] for k, at in found.items()}


def read_query(q: str, use_intents: bool = True) -> list[Group]:
    """Groups of a query: one per kind it names, one per other word that is no stop word."""
    words = query_words(q)
    named = intents(words) if use_intents else {}
    used = {w for ws in named.values() for w in ws}
    groups = [Group((k, *fixed.KIND_PHRASES[k]), len(ws)) for k, ws in named.items()]
    return groups + [Group((w,)) for w in words if w not in used and w not in STOP_WORDS]


# -- the corpus (H5-H9) --


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, apostrophes inside kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def vocabulary(docs: DataFrame, fields: list[str], least: int = 3, most: int = 40) -> DataFrame:
    """(term, docs): in how many documents each term occurs."""
    found = F.array_distinct(F.flatten(F.array(*[tokens(F.col(f)) for f in fields])))
    terms = docs.select(F.explode(found).alias("term")).where(F.length("term").between(least, most) & F.col("term").rlike(r"^[a-z][a-z'-]*$"))
    return terms.groupBy("term").agg(F.count("*").alias("docs"))


def stored_terms(docs: DataFrame, fields: list[str], root: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, docs, grams, stem) with the rarest trigrams first, and (gram, df): the current version at ``root``, made anew for another source."""
    spark = docs.sparkSession
    found = commits.current(spark, root)
    if found is None or source is None or found.properties.get("source") != source:

        def write(folder: str) -> None:
            vocabulary(docs, fields).write.parquet(f"{folder}/vocabulary")
            sets = spark.read.parquet(f"{folder}/vocabulary").withColumn("grams", trigrams(F.col("term")))
            gram_counts(sets).coalesce(1).write.parquet(f"{folder}/grams")  # a few thousand rows, as many as trigrams there are
            by_rarity(sets, "term", spark.read.parquet(f"{folder}/grams"), carry=("docs",)).withColumn("stem", stems(F.col("term"))).write.parquet(f"{folder}/terms")

        commits.commit(spark, root, write, {"source": source})
    return commits.read(spark, root, "terms"), commits.read(spark, root, "grams")


def inflected(groups: list[Group], terms: DataFrame) -> list[Group]:
    """The groups with all known terms of the same stem as one of their words: inflected forms match, phrases stay as they are.

    ``terms`` has (term, stem); only the forms of the query's words leave it.
    """
    wanted = {stem(t.lower()) for g in groups for t in g.terms if re.fullmatch(r"[a-z]+(?:'[a-z]+)?", t.lower())}
    forms: dict[str, list[str]] = {}
    for r in terms.where(F.col("stem").isin(sorted(wanted))).select("term", "stem").orderBy("term").collect() if wanted else []:
        forms.setdefault(r["stem"], []).append(r["term"])
    return [replace(g, terms=tuple(dict.fromkeys([*g.terms, *(f for t in g.terms for f in forms.get(stem(t.lower()), []))]))) for g in groups]


def expand(words: list[str], vocab: DataFrame, spelling: int = 5, forms: int = 3, close: float = 0.5, counts: DataFrame | None = None) -> DataFrame:
    """(word, term, similarity, docs, correction) of words worth expanding (H5, A.6).

    A known word gets up to ``forms`` terms with its first four letters; an
    unknown one the nearest of ``spelling`` terms within its edits. With
    ``counts``, ``vocab`` has its grams already (:func:`stored_terms`) and the
    words meet it by their rarest grams.
    """
    spark = vocab.sparkSession
    asked = [w for w in words if len(w) >= 4 and w[0].isascii() and w[0].isalpha() and w not in STOP_WORDS]
    rows = spark.createDataFrame([(w, max_edits(w)) for w in asked], "word string, edits int")
    # the vocabulary is gone through once: a word that meets itself is known
    if counts is None:
        near = similar_terms(rows, "word", vocab, "term", carry=("docs",), same=True)
    else:
        sets = by_rarity(rows.withColumn("grams", trigrams(F.col("word"))), "word", counts)
        near = similar_sets(F.broadcast(sets), "word", vocab, "term", LEAST_SIMILARITY, carry=("docs",))
    near = near.join(F.broadcast(rows), "word")
    near = near.withColumn("known", F.max(F.col("word") == F.col("term")).over(Window.partitionBy("word"))).where("word <> term")
    near = near.where(~F.col("known") | ((F.substring("word", 1, 4) == F.substring("term", 1, 4)) & (F.col("similarity") >= close)))
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), F.desc("docs"), "term")
    ranked = near.withColumn("n", F.row_number().over(order)).where((F.col("known") & (F.col("n") <= forms)) | (~F.col("known") & (F.col("n") <= spelling)))
    spelled = ranked.where(~F.col("known")).where(F.levenshtein("word", "term") <= F.col("edits"))
    best = spelled.withColumn("m", F.row_number().over(order)).where("m = 1").drop("m")
    return ranked.where("known").unionByName(best).select("word", "term", "similarity", "docs", (~F.col("known")).alias("correction"))


def matched_groups(docs: DataFrame, doc_id: str, fields: dict[str, str], groups: list[Group], condition: Column | None = None) -> DataFrame:
    """(doc_id, group, weight, field, tf): occurrences of each group in each weighted field.

    ``fields`` maps A, B or C to a column. A phrase is words beside each other.
    """
    rows = docs.where(condition) if condition is not None else docs
    # words two blanks apart, so that neighbours never share one; worked out once a text
    joined = {w: F.concat(F.lit("  "), F.array_join(tokens(F.col(c)), "  "), F.lit("  ")) for w, c in fields.items()}
    firsts = {m.group() for group in groups for term in group.terms if (m := re.search(r"[a-z0-9]+(?:'[a-z]+)?", term.lower()))}
    if firsts:  # a text without the first word of any term has no match; that is cheaper to see than its words
        rows = rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False)) for c in fields.values() for t in sorted(firsts)]))
    told = []
    for g, group in enumerate(groups):
        for w in fields:
            count = F.lit(0)
            for term in group.terms:
                needle = " " + " ".join(re.findall(r"[a-z0-9]+(?:'[a-z]+)?", term.lower())) + " "
                if needle.strip():
                    count = count + occurrences(F.col(f"__{w}"), needle)
            told.append(F.struct(F.lit(g).alias("group"), F.lit(group.weight).alias("weight"), F.lit(w).alias("field"), count.alias("tf")))
    found = rows.select(doc_id, *[c.alias(f"__{w}") for w, c in joined.items()]).select(doc_id, F.explode(F.filter(F.array(*told), lambda x: x["tf"] > 0)).alias("x"))
    return found.select(doc_id, "x.group", "x.weight", "x.field", "x.tf")


def occurrences(spaced: Column, needle: str) -> Column:
    """How often a term occurs in a text whose words lie two blanks apart and two from its ends."""
    wide = " " + needle.strip().replace(" ", "  ") + " "
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(wide), F.lit("")))) / len(wide)).cast("int")


def text_scores(matches: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, coverage, weight): weight of matched groups, and weighted frequency."""
    value = F.create_map(*[F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv])
    groups = matches.groupBy(doc_id, "group", "weight").agg(F.round(F.sum(F.try_element_at(value, F.col("field")) * (1 + F.log("tf"))), 9).alias("w"))
    return groups.groupBy(doc_id).agg(F.sum("weight").alias("coverage"), F.round(F.sum("w"), 6).alias("weight"))


def text_candidates(matches: DataFrame, doc_id: str, limit: int = CANDIDATES) -> DataFrame:
    """(doc_id, coverage, weight, rank): by coverage, then weight, then id."""
    return ranked(text_scores(matches, doc_id), [F.desc("coverage"), F.desc("weight"), F.asc(doc_id)], limit)


def ranked(scored: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Numbered in order; the window only sees what the limit left."""
    return scored.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def vector_candidates(rows: DataFrame, row_id: str, vector: str, query: list[float], condition: Column | None = None, limit: int = CANDIDATES, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(row_id, distance, rank): the nearest by cosine, those too far dropped after the limit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = rows.where(condition) if condition is not None else rows
    near = rows.where(F.col(vector).isNotNull()).select(row_id, F.round(1 - cosine(F.col(vector), q), 9).alias("distance")).where(F.col("distance").isNotNull())
    near = near.orderBy("distance", row_id).limit(limit).where(F.col("distance") <= 1 - least)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", row_id)))


def fuse(lists: list[DataFrame], row_id: str, k: int = FUSION) -> DataFrame:
    """(row_id, score): reciprocal ranks summed over the lists, best first."""
    both = None
    for ranked in lists:
        part = ranked.select(row_id, (1.0 / (k + F.col("rank"))).alias("r"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(row_id).agg(F.round(F.sum("r"), 9).alias("score")).orderBy(F.desc("score"), row_id)


def hashing_embedder(dim: int = 64, stem: int = 6) -> Callable[[str], list[float]]:
    """A stand-in embedder (H17): signed hashes of word stems, unit length. Deterministic."""
    import zlib

    def embed(text: str) -> list[float]:
        out = [0.0] * dim
        for word in query_words(text):
            h = zlib.crc32(word[:stem].encode())
            out[h % dim] += 1.0 if h & 0x8000 else -1.0
        norm = sum(x * x for x in out) ** 0.5
        return [x / norm for x in out] if norm else out

    return embed


def embed_query(q: str, embedder: Callable[[str], list[float] | None] | None) -> list[float] | None:
    """The query's vector, or None if there is no embedder or it fails; search goes on with text alone."""
    try:
        return embedder(q) if embedder else None
    except Exception:  # noqa: BLE001 - whatever an outside service raises, text search goes on
        return None


def search(docs: DataFrame, doc_id: str, fields: dict[str, str], q: str, vector: str | None = None, embedder=None, condition: Column | None = None) -> DataFrame:
    """(doc_id, score) by fused ranks; a query that finds nothing by intents is read again literally."""
    vec = embed_query(q, embedder) if vector else None

    def run(groups: list[Group]) -> DataFrame | None:
        lists = []
        if groups:
            lists.append(text_candidates(matched_groups(docs, doc_id, fields, groups, condition), doc_id))
        if vec is not None:
            lists.append(vector_candidates(docs, doc_id, vector, vec, condition))
        return fuse(lists, doc_id) if lists else None

    found = run(read_query(q))
    if intents(query_words(q)) and (found is None or found.isEmpty()):
        found = run(read_query(q, use_intents=False))
    if found is None:
        return docs.select(doc_id, F.lit(0.0).alias("score")).limit(0)
    return found


def relevant(text: Column, wanted: list[str], unwanted: list[str] = ()) -> Column:
    """A judge's verdict: every wanted pattern is found, no unwanted one is."""
    ok = F.lit(True)
    for p in wanted:
        ok = ok & text.rlike(f"(?i){p}")
    for p in unwanted:
        ok = ok & ~text.rlike(f"(?i){p}")
    return F.coalesce(ok, F.lit(False))


def embed_changed(rows: DataFrame, keys: list[str], content: Column, embedder: Callable[[str], list[float]], model: str, known: DataFrame | None = None, batch: int = 128) -> DataFrame:
    """(keys, embedding, hash) of rows whose model and content are not those on record.

    What has not changed never reaches the embedder. Each task asks for ``batch``
    texts at a time; a task that fails runs again as a whole.
    """
    todo = rows.select(*keys, content.alias("__content")).withColumn("hash", F.sha2(F.concat(F.lit(f"{model}\n"), "__content"), 256))
    if known is not None:
        todo = todo.join(known.select(*keys, "hash"), [*keys, "hash"], "left_anti").select(*keys, "__content", "hash")

    def embed(parts):
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                yield some.assign(embedding=[embedder(t) for t in some["__content"]]).drop(columns="__content")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.drop("__content").schema)
    return todo.mapInPandas(embed, f"{fields}, embedding array<double>")
