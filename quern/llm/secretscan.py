"""Secret scans: fixed patterns, and strings that look drawn at random by two character Markov models.

Base spans are the matches of three patterns: an assignment to a name such as
``token``, an access key, a long run of hexadecimal digits. To these the models
add what no pattern names. Each is a first-order Markov chain over the characters
``+ - / _``, digits and letters, with add-one smoothing:

    random      trained on strings labelled random: digits of SHA-256 in
                hexadecimal, Base64 and upper-case form (SAMPLES of each)
    ordinary    trained on what is labelled ordinary: the distinct words and
                identifiers of ``LEAST_WORD`` characters or more that
                ``LEAST_DOCS`` documents hold outside base spans, over the whole
                table, and SAMPLES decimal numbers

A candidate is a maximal run of such characters, ``LEAST_RUN`` or longer, outside
the matches of the assignment pattern, which holds no other base span; a run that
touches a letter beyond ASCII is a part of a word and none. It is added, as kind
``model``, if the random model makes it 2^ODDS times as likely as the ordinary
one does, secrets being rare. Log-likelihoods are whole thousandths of a bit, so
sums are exact.

Scanning is column expressions only and shuffles nothing. Training shuffles word
counts; only the counts of pairs of characters, a few thousand whatever the
input, reach the driver.

A span is the whole match, in code points, its end exclusive.

Defined results
  null or empty text  no spans
  null doc_id         scanned like any other
  repeated rows       each gives its row; each counts as a document of its words
  ties                spans with the same start stand in the order of KINDS
  long text           counts whole; places are found by running sums in blocks, in linear time
  empty table         empty result; the ordinary model then knows the numbers only
  extra columns       ``scan`` keeps them, except one named ``spans``, which is replaced
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import aside, session_of

#: The base patterns.
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
LEAST_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "model")

#: A character of a candidate, or one beyond ASCII.
RUN = r"[^\x00-\x2A\x2C\x2E\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"
ALPHABET = "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
#: The same class with each ASCII character that is none named by itself: Java looks one up in a table then, and goes through ranges one by one, 25 times as slowly.
LOOKED_UP = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if chr(c) not in ALPHABET) + "]"
FIRST, WIDTH = 43, 80
LEAST_RUN, LEAST_WORD, LEAST_DOCS, SAMPLES, ODDS = 20, 8, 3, 1024, 20

_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, block: int = 512) -> Column:
    """Running sums of an array of ints, by blocks: appending to one long array would take quadratic time."""

    def scan(some: Column) -> Column:
        return F.reduce(some, F.array().cast("array<int>"), lambda done, x: F.array_append(done, x + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0))))

    def joined(sums: Column) -> Column:
        ends = scan(F.transform(sums, lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))))
        return _let(ends, lambda e: F.flatten(F.transform(sums, lambda s, b: F.transform(s, lambda x: x + F.when(b > 0, F.get(e, b - 1)).otherwise(F.lit(0))))))

    def blocks(v: Column) -> Column:
        n = F.floor((F.size(v) - 1) / block).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda b: scan(F.slice(v, b * block + 1, F.lit(block)))), joined)

    return _let(values, blocks)


def located(text: Column, pattern: str) -> Column:
    """(start, end, body) of each match, from the matches and what lies between them."""

    def places(v: Column) -> Column:
        steps = F.transform(v["found"], lambda _, i: F.length(F.get(v["between"], i)) + F.when(i > 0, F.length(F.get(v["found"], i - 1))).otherwise(F.lit(0)))
        return _let(running(steps), lambda at: F.transform(v["found"], lambda m, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("body"))))

    both = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), _let(both, places)).otherwise(F.array().cast("array<struct<start: int, end: int, body: string>>"))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


@dataclass(frozen=True)
class Model:
    """Thousandths of a bit by which each pair of characters speaks for the random model."""

    scores: tuple[int, ...]
    odds: int = ODDS * 1000

    def score(self, run: Column) -> Column:
        """The log-likelihood ratio of an ASCII run of candidate characters."""
        # an array literal once the optimizer has folded it
        table = F.from_json(F.lit(json.dumps(self.scores)), "array<int>")
        codes = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.ascii(F.substr(run, i, F.lit(1))) - FIRST)
        pair = lambda c: F.reduce(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0), lambda s, i: s + F.get(table, F.get(c, i - 1) * WIDTH + F.get(c, i)))
        return _let(codes, pair)


def random_samples(spark: SparkSession, samples: int = SAMPLES) -> DataFrame:
    """(label, word): strings labelled random and numbers labelled ordinary, from SHA-256 of a counter."""
    made = lambda kind: F.sha2(F.concat(F.lit(kind), F.col("id").cast("string")), 256)
    b64 = lambda kind: F.base64(F.unhex(made(kind)))
    kinds = {
        "hex": ("random", made("hex")),
        "base64": ("random", F.rtrim(b64("base64"), F.lit("="))),
        "upper": ("random", F.translate(F.upper(b64("upper")), "+/=", "")),
        "number": ("ordinary", F.conv(F.substring(made("number"), 1, 15), 16, 10)),
    }
    rows = F.array(*[F.struct(F.lit(label).alias("label"), word.alias("word")) for label, word in kinds.values()])
    return spark.range(samples).select(F.inline(rows))


def ordinary_words(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(word): words and identifiers that enough documents hold outside base spans."""
    base = f"{ASSIGN}|{ACCESS}|{HEX}"
    t = F.col(text)
    rest = F.when(t.rlike(base), F.regexp_replace(t, base, " ")).otherwise(t)
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(f"{LOOKED_UP}{{{LEAST_WORD},}}"), F.lit(0)))).alias("word"))
    held = words.where(F.length("word") == F.octet_length("word")).groupBy("word").agg(F.count("*").alias("docs"))
    return held.where(F.col("docs") >= least_docs).select("word")


def pair_counts(words: DataFrame) -> dict[tuple[str, str], int]:
    """How often each character follows each, over ASCII words of candidate characters; as many rows as pairs of the alphabet at most."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(2)))).alias("pair"))
    return {(p[0], p[1]): n for p, n in pairs.groupBy("pair").agg(F.count("*")).collect()}


def likelihood_ratios(random: dict, ordinary: dict) -> tuple[int, ...]:
    """A table of WIDTH x WIDTH scores by character codes."""

    def logs(counts: dict) -> dict:
        of = dict.fromkeys(ALPHABET, len(ALPHABET))
        for (a, _), n in counts.items():
            of[a] += n
        return {(a, b): log2((counts.get((a, b), 0) + 1) / of[a]) for a in ALPHABET for b in ALPHABET}

    r, o = logs(random), logs(ordinary)
    scores = [0] * (WIDTH * WIDTH)
    for a, b in r:
        scores[(ord(a) - FIRST) * WIDTH + ord(b) - FIRST] = round(1000 * (r[a, b] - o[a, b]))
    return tuple(scores)


def train(docs: DataFrame, text: str = "text") -> Model:
    """Both models from their labelled samples."""
    samples = random_samples(session_of(docs))
    ordinary = ordinary_words(docs, text).unionByName(samples.where("label = 'ordinary'").select("word"))
    return Model(likelihood_ratios(pair_counts(samples.where("label = 'random'").select("word")), pair_counts(ordinary)))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (start, kind, end), sorted, the kind a place in KINDS."""
    docs, back = aside(docs, "__t", "__assign", "__gaps", "__base", "__added")
    kept = [c for c in docs.columns if c != "spans"]
    t = F.col("__t")
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    long_value = lambda m: F.length(F.regexp_extract(m["body"], ASSIGN, 2)) >= LEAST_VALUE
    rows = rows.select("*", located(t, ASSIGN).alias("__assign"))

    def gaps(found: Column) -> Column:
        """(start, body) of what lies outside the assignments."""
        between = F.split(t, ASSIGN, -1)
        cut = lambda b: F.transform(b, lambda g, i: F.struct(F.when(i > 0, F.get(found, i - 1)["end"]).otherwise(F.lit(0)).alias("start"), g.alias("body")))
        return F.when(F.size(found) > 0, _let(between, cut)).otherwise(F.array(F.struct(F.lit(0).alias("start"), t.alias("body"))))

    random = lambda m: (F.length(m["body"]) == F.octet_length(m["body"])) & ~m["body"].rlike(f"{HEX}|{ACCESS}") & (model.score(m["body"]) >= model.odds)
    runs = lambda g: F.filter(located(g["body"], f"{LOOKED_UP}{{{LEAST_RUN},}}"), random)
    moved = lambda g: F.transform(runs(g), lambda m: F.struct((m["start"] + g["start"]).alias("start"), F.lit(KINDS.index("model")).alias("kind"), (m["end"] + g["start"]).alias("end")))
    found = F.concat(
        _spans(F.filter("__assign", long_value), "assign"),
        _spans(located(t, ACCESS), "access"),
        _spans(located(t, HEX), "hex"),
        F.when(t.rlike(f"{LOOKED_UP}{{{LEAST_RUN},}}"), F.flatten(F.transform(gaps(F.col("__assign")), moved))).otherwise(F.array().cast(_SPANS)),
    )
    return rows.select(*kept, F.sort_array(found).alias("spans")).withColumnsRenamed(back)


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    kinds = F.array(*map(F.lit, KINDS))
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    many = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] < KINDS.index("model"))
    return scanned.select(doc_id, *[many(k) for k in KINDS[:3]], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
