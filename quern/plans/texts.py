"""Texts: vocabulary, typos, search, vectors and classification."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import functions as F

from quern.functions import colour, detect, tags, text
from quern.operators import facets, joins, search, textindex, versions
from quern.plans.registry import query, table
from quern.sources import commits, files

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:''[a-z]+)?')"
VOCAB = f"SELECT term, count(*) AS docs FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM documents) WHERE length(term) BETWEEN 3 AND 40 AND regexp_matches(term, '^[a-z][a-z''-]*$') GROUP BY 1"
GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3)))"


@query(VOCAB)
def vocab_docfreq(spark, sf_dir):
    """Terms and in how many documents they occur."""
    return search.vocabulary(table(spark, sf_dir, "documents"), ["text"])


def documents_terms(spark, sf_dir):
    """The documents' terms with their trigrams, and the trigrams' counts: made when the table has changed, read otherwise."""
    root = f"{commits.workspace(spark)}/terms-{crc32(sf_dir.encode()):08x}"
    return search.stored_terms(table(spark, sf_dir, "documents"), ["text"], root, commits.signature(spark, f"{sf_dir}/documents.parquet"))


ASKED = ("nation", "tionheed", "there", "wheather", "andd")
SIMILAR = f"""
v AS ({VOCAB}), w AS (SELECT unnest({list(ASKED)!r}) AS word),
vg AS (SELECT term, docs, {GRAMS.format('term')} AS g FROM v), wg AS (SELECT word, {GRAMS.format('word')} AS g FROM w),
s AS (SELECT word, term, docs, len(list_intersect(vg.g, wg.g)) / (len(vg.g) + len(wg.g) - len(list_intersect(vg.g, wg.g))) AS similarity FROM wg, vg WHERE word <> term),
n AS (SELECT word, term, docs, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3)
"""


@query(f"WITH {SIMILAR} SELECT word, term, similarity FROM n")
def trigram_neighbours(spark, sf_dir):
    """Terms of the corpus that share enough trigrams with a few words."""
    words = files.inline(spark, [(w,) for w in ASKED], "word string")
    vocab = search.vocabulary(table(spark, sf_dir, "documents"), ["text"])
    return joins.similar_terms(words, "word", vocab, "term").select("word", "term", F.round("similarity", 6).alias("similarity"))


@query(
    f"""
WITH {SIMILAR},
k AS (SELECT n.*, EXISTS (SELECT 1 FROM v WHERE v.term = n.word) AS known FROM n),
f AS (SELECT * FROM k WHERE NOT known OR (substr(word, 1, 4) = substr(term, 1, 4) AND similarity >= 0.5)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, docs DESC, term) AS i FROM f),
c AS (SELECT * FROM r WHERE NOT known AND i <= 5 AND levenshtein(word, term) <= CASE WHEN length(word) >= 8 THEN 2 ELSE 1 END QUALIFY row_number() OVER (PARTITION BY word ORDER BY i) = 1)
SELECT word, term, similarity, docs, NOT known AS correction FROM (SELECT * FROM r WHERE known AND i <= 3 UNION ALL SELECT * FROM c)
"""
)
def typo_correct(spark, sf_dir):
    """Other forms of known words, and the nearest term for unknown ones, by the stored terms."""
    terms, counts = documents_terms(spark, sf_dir)
    return search.expand(list(ASKED), terms, counts=counts).withColumn("similarity", F.round("similarity", 6))


@query(
    f"WITH v AS ({VOCAB}), b AS ({VOCAB.replace('FROM documents', 'FROM benchmark')}), vg AS (SELECT term, unnest({GRAMS.format('term')}) AS g FROM v), bg AS (SELECT term, unnest({GRAMS.format('term')}) AS g FROM b), "
    "n AS (SELECT term, count(*) AS n FROM vg GROUP BY 1), m AS (SELECT term, count(*) AS n FROM bg GROUP BY 1), "
    "k AS (SELECT bg.term AS word, vg.term, count(*) AS k FROM bg JOIN vg USING (g) WHERE bg.term <> vg.term GROUP BY ALL) "
    "SELECT word, k.term, round(k / (m.n + n.n - k), 6) AS similarity FROM k JOIN m ON m.term = word JOIN n ON n.term = k.term WHERE k / (m.n + n.n - k) >= 0.5"
)
def benchmark_spellings(spark, sf_dir):
    """All terms of the documents that are spelled like a term of the benchmark items: a join of sets by their rarest trigrams."""
    terms, counts = documents_terms(spark, sf_dir)
    words = search.vocabulary(table(spark, sf_dir, "benchmark"), ["text"]).select(F.col("term").alias("word"), joins.trigrams(F.col("term")).alias("grams"))
    found = joins.similar_sets(joins.by_rarity(words, "word", counts), "word", terms, "term", 0.5)
    return found.where("word <> term").withColumn("similarity", F.round("similarity", 6))


Q = "nation there of erthre wheather"
GROUPS = ("nation", "there", "erthre", "wheather")


def _fields():
    return {"C": "text"}


def _occ(w: str) -> str:
    """Occurrences of a word in a doubled-blank text."""
    return f"cast((length(d) - length(replace(d, ' {w} ', ''))) / {len(w) + 2} AS INTEGER)"


RANK_SQL = (
    f"d AS (SELECT doc_id, replace(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' ', '  ') AS d FROM documents), m AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS g, {_occ(w)} AS tf FROM d" for i, w in enumerate(GROUPS))
    + "), x AS (SELECT doc_id, g, round(0.2 * (1 + ln(tf)), 9) AS w FROM m WHERE tf > 0), s AS (SELECT doc_id, count(*) AS coverage, round(sum(w), 6) AS weight FROM x GROUP BY 1), "
    "fts AS (SELECT *, row_number() OVER (ORDER BY coverage DESC, weight DESC, doc_id) AS rank FROM s QUALIFY rank <= 200)"
)


@query(f"WITH {RANK_SQL} SELECT doc_id, coverage, weight, rank FROM fts")
def fts_coverage_topk(spark, sf_dir):
    """Documents by groups matched, then weighted frequency."""
    groups = [g for g in search.read_query(Q, use_intents=False)]
    found = search.matched_groups(table(spark, sf_dir, "documents"), "doc_id", _fields(), groups)
    return search.text_candidates(found, "doc_id")


FIELD_SQL = (
    f"WITH d AS (SELECT doc_id, lang, replace(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' ', '  ') AS d FROM documents), m AS ("
    f"SELECT doc_id, 0 AS g, {_occ('the')} AS tf, 0.2 AS f FROM d UNION ALL SELECT doc_id, 0, 0, 1.0 FROM d UNION ALL SELECT doc_id, 1, {_occ('en')}, 0.2 FROM d UNION ALL SELECT doc_id, 1, CASE WHEN lang = 'en' THEN 1 ELSE 0 END, 1.0 FROM d"
    "), x AS (SELECT doc_id, g, round(sum(f * (1 + ln(tf))), 9) AS w FROM m WHERE tf > 0 GROUP BY 1, 2), s AS (SELECT doc_id, count(*) AS coverage, round(sum(w), 6) AS weight FROM x GROUP BY 1) "
    "SELECT *, row_number() OVER (ORDER BY coverage DESC, weight DESC, doc_id) AS rank FROM s QUALIFY rank <= 50"
)


@query(FIELD_SQL)
def fts_field_rank(spark, sf_dir):
    """Two weighted fields: the language as field A, the text as field C."""
    groups = [search.Group(("the",)), search.Group(("en",))]
    found = search.matched_groups(table(spark, sf_dir, "documents"), "doc_id", {"A": "lang", "C": "text"}, groups)
    return search.text_candidates(found, "doc_id", 50)


def documents_index(spark, sf_dir) -> textindex.Index:
    """The positional index of the documents: built when the table has changed, read otherwise."""
    root = f"{commits.workspace(spark)}/text-index-{crc32(sf_dir.encode()):08x}"
    source = commits.signature(spark, f"{sf_dir}/documents.parquet")
    return textindex.current(spark, root, source) or textindex.build(table(spark, sf_dir, "documents"), "doc_id", {"A": "lang", "C": "text"}, root, source=source)


@query(f"WITH {RANK_SQL} SELECT doc_id, coverage, weight, rank FROM fts")
def index_coverage_topk(spark, sf_dir):
    """The rows of fts_coverage_topk, from the stored index."""
    groups = search.read_query(Q, use_intents=False)
    return textindex.top(documents_index(spark, sf_dir).only("C"), groups).withColumnRenamed("doc", "doc_id")


@query(FIELD_SQL)
def index_field_rank(spark, sf_dir):
    """The rows of fts_field_rank, from the stored index."""
    found = textindex.top(documents_index(spark, sf_dir), [search.Group(("the",)), search.Group(("en",))], 50)
    return found.withColumnRenamed("doc", "doc_id")


@query()
def index_stemmed_topk(spark, sf_dir):
    """The best documents for a query's words in any inflected form, from the stored index and terms."""
    terms, _ = documents_terms(spark, sf_dir)
    groups = search.inflected(search.read_query(Q, use_intents=False), terms)
    return textindex.top(documents_index(spark, sf_dir).only("C"), groups).withColumnRenamed("doc", "doc_id")


PHRASES = ("the the", "of the", "in the nation", "the the the")


@query(
    f"WITH d AS (SELECT doc_id, replace(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' ', '  ') AS d FROM documents), x AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{p}' AS phrase, cast((length(d) - length(replace(d, ' {p.replace(' ', '  ')} ', ''))) / {len(p.replace(' ', '  ')) + 2} AS BIGINT) AS times FROM d" for p in PHRASES)
    + ") SELECT * FROM x WHERE times > 0"
)
def index_phrases(spark, sf_dir):
    """How often documents hold some phrases, from positions alone."""
    groups = [search.Group((p,)) for p in PHRASES]
    names = F.array(*map(F.lit, PHRASES))
    found = textindex.matched(documents_index(spark, sf_dir).only("C"), groups)
    return found.select(F.col("doc").alias("doc_id"), F.get(names, "group").alias("phrase"), F.col("tf").cast("long").alias("times"))


@query()
def intent_query(spark, sf_dir):
    """A query that names a kind of block, over the raw pages."""
    return search.search(table(spark, sf_dir, "pages"), "page_id", {"C": "html"}, "shipping and retruns menu")


KNN_SQL = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7), sem AS (SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS distance FROM embeddings, q), near AS (SELECT * FROM sem ORDER BY distance, vec_id LIMIT 200), ranked AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM near WHERE distance <= 0.7)"


def _query_vector(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"])


@query(f"WITH {KNN_SQL} SELECT vec_id, round(distance, 6) AS distance, rank FROM ranked")
def knn_cosine(spark, sf_dir):
    """The nearest vectors by cosine, exactly."""
    found = search.vector_candidates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"WITH {RANK_SQL}, {KNN_SQL}, f AS (SELECT doc_id, rank FROM fts UNION ALL SELECT vec_id, rank FROM ranked) SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM f GROUP BY 1")
def rrf_fusion(spark, sf_dir):
    """Text and vector ranks fused."""
    sem = search.vector_candidates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf_dir)).withColumnRenamed("vec_id", "doc_id")
    return search.fuse([fts_coverage_topk(spark, sf_dir), sem], "doc_id")


@query(f"WITH {RANK_SQL}, h AS (SELECT lang, source FROM documents JOIN fts USING (doc_id)) SELECT 'lang' AS key, lang AS value, count(*) AS n FROM h GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM h GROUP BY 2 UNION ALL SELECT '#total', '', count(*) FROM h HAVING count(*) > 0")
def search_facets(spark, sf_dir):
    """Facets over what a search found."""
    found = table(spark, sf_dir, "documents").join(fts_coverage_topk(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return facets.facet_counts(found, {k: facets.Facet(F.col(k)) for k in ("lang", "source")}, facets.Filters())




@query(
    f"""
WITH c AS (SELECT p_partkey, (p_partkey * 37 % 256) / 255 AS r, (p_partkey * 91 % 256) / 255 AS g, (p_partkey * 53 % 256) / 255 AS b FROM part),
x AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM c), y AS (SELECT *, (mx + mn) / 2 AS l, mx - mn AS ch FROM x),
z AS (SELECT *, CASE WHEN ch = 0 THEN 0 ELSE ch / (1 - abs(2 * l - 1)) END AS s, CASE WHEN ch = 0 THEN 0 WHEN mx = r THEN fmod((g - b) / ch, 6) WHEN mx = g THEN (b - r) / ch + 2 ELSE (r - g) / ch + 4 END AS h6 FROM y),
h AS (SELECT *, fmod(h6 * 60 + 360, 360) AS h FROM z)
SELECT p_partkey, CASE WHEN s < 0.15 OR ch < 0.06 THEN CASE WHEN l > 0.94 THEN 'white' WHEN l > 0.78 THEN 'light' WHEN l > 0.35 THEN 'grey' WHEN l > 0.14 THEN 'dark' ELSE 'black' END
  WHEN h < 15 THEN 'red' WHEN h < 45 THEN 'orange' WHEN h < 70 THEN 'yellow' WHEN h < 160 THEN 'green' WHEN h < 195 THEN 'teal' WHEN h < 255 THEN 'blue' WHEN h < 290 THEN 'purple' WHEN h < 335 THEN 'pink' ELSE 'red' END AS bucket FROM h
"""
)
def colour_bucket(spark, sf_dir):
    """Buckets of colours made from part keys."""
    css = F.format_string("rgb(%d, %d, %d)", *[(F.col("p_partkey") * m % 256).cast("int") for m in (37, 91, 53)])
    return table(spark, sf_dir, "part").select("p_partkey", colour.bucket(css).alias("bucket"))


PATH = "coalesce(nullif(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')"


def _case(p: str) -> str:
    return f"CASE WHEN {p} = '/' THEN 'home' " + " ".join(f"WHEN regexp_matches({p}, '{r}') THEN '{t}'" for r, t in text.fixed.PAGE_TYPE_PATTERNS[1:]) + " ELSE 'other' END"


@query(
    f"""
WITH p AS (SELECT page_id, url, {PATH} AS path FROM pages),
q AS (SELECT *, regexp_matches(path, '^/[a-zA-Z]{{2}}([-_][a-zA-Z]{{2}})?(/|$)') AS loc,
  coalesce(nullif(regexp_replace(regexp_replace(path, '^/[a-zA-Z]{{2}}([-_][a-zA-Z]{{2}})?(/|$)', '/'), '^/[a-zA-Z]{{2}}([-_][a-zA-Z]{{2}})?(/|$)', '/'), ''), '/') AS bare FROM p)
SELECT page_id, CASE WHEN {_case('path')} = 'other' AND loc THEN {_case('bare')} ELSE {_case('path')} END AS page_type,
  substr(CASE WHEN path = '/' THEN 'home' ELSE lower(regexp_replace(regexp_replace(trim(path, '/'), '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g')) END
  || CASE WHEN regexp_extract(url, '[?]([^#]*)', 1) <> '' THEN '-' || substr(sha1('?' || regexp_extract(url, '[?]([^#]*)', 1)), 1, 6) ELSE '' END, 1, 80) AS slug
FROM q
"""
)
def page_type_slug(spark, sf_dir):
    """Page types and slugs of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", text.page_type(F.col("url")).alias("page_type"), text.page_slug(F.col("url")).alias("slug"))


@query("SELECT page_id, nullif(regexp_extract(html, '<html[^>]*\\slang=\"([a-zA-Z]{2}(-[a-zA-Z]{2})?)\"', 1), '') AS locale, CASE WHEN contains(lower(html), 'woocommerce') THEN 'woocommerce' WHEN contains(lower(html), '/wp-content/') THEN 'wordpress' END AS platform FROM pages")
def html_fingerprint(spark, sf_dir):
    """Platform and locale of pages."""
    found = table(spark, sf_dir, "pages").select("page_id", detect.fingerprint(F.col("html")).alias("f"))
    return found.select("page_id", "f.locale", "f.platform")


APPS = (("tracker", "track\\("), ("nav", "<nav>"), ("canonical", "rel=.canonical"))


@query("SELECT page_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(html, '(?i){p}') THEN '{n}' END" for n, p in APPS) + "], lambda x: x IS NOT NULL) AS apps FROM pages")
def html_apps(spark, sf_dir):
    """Apps by pattern, with patterns that the test pages have."""
    return table(spark, sf_dir, "pages").select("page_id", detect.apps(F.col("html"), APPS).alias("apps"))


def _marks(marks):
    return " + ".join("CAST(contains(lower(html), '" + m.replace("'", "''") + "') AS INTEGER)" for m in marks)


@query(f"SELECT page_id, {_marks(text.fixed.STRONG_SIGNALS)} AS strong, {_marks(text.fixed.WEAK_SIGNALS)} AS weak FROM pages")
def store_signals(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", detect.signal_count(html, text.fixed.STRONG_SIGNALS).alias("strong"), detect.signal_count(html, text.fixed.WEAK_SIGNALS).alias("weak"))


@query(
    "SELECT DISTINCT page_id, host FROM (SELECT page_id, regexp_extract(url, '^https?://(?:www[.])?([^/:?#]+)', 1) AS own, regexp_replace(lower(regexp_extract(u, '^https?://([^/:?#]+)', 1)), '^www[.]', '') AS host "
    "FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"(http[^\"]+)\"', 1)) AS u FROM pages)) WHERE regexp_matches(host, '^[a-z0-9.-]+[.][a-z]{2,}$') AND host IS DISTINCT FROM own"
)
def links_outbound(spark, sf_dir):
    """Hosts that each page links to."""
    return files.outbound_links(table(spark, sf_dir, "pages"), "page_id", "html", text.host_of(F.col("url"))).select("page_id", "host")


WORDS = {"alpha": ["the", "of", "erthre"], "beta": ["and", "la"], "gamma": ["der", "un", "los"]}


def _hits(words, t):
    return "least(" + " + ".join(f"cast((length({t}) - length(replace({t}, ' {w} ', ''))) / {len(w) + 2} AS INTEGER)" for w in words) + ", 12)"


@query(
    "WITH t AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^a-z0-9&+\\-'' ]+', ' ', 'g') || ' ' AS t, ' ' || regexp_replace(lower(source), '[^a-z0-9&+\\-'' ]+', ' ', 'g') || ' ' AS s FROM documents), "
    + "h AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS industry, {_hits(w, 't')} * 0.5 + {_hits(w, 's')} * 3 AS score, {i} AS i FROM t" for i, (k, w) in enumerate(WORDS.items()))
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM h WHERE score > 0) SELECT d.doc_id, CASE WHEN r.score >= 3 THEN r.industry ELSE 'other' END AS industry, coalesce(r.score, 0)::DOUBLE AS score FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.n = 1"
)
def industry_score(spark, sf_dir):
    """Weighted keyword scores with a cap; the keyword lists are a parameter."""
    guess = detect.industry([(F.col("source"), 3.0), (F.col("text"), 0.5)], WORDS)
    return table(spark, sf_dir, "documents").select("doc_id", guess.alias("g")).select("doc_id", "g.industry", "g.score")


HOSTS = "h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www[.]', '') AS host FROM pages)"


@query(f"WITH {HOSTS}, r(domain, rank) AS (VALUES ('example.com', 10), ('example.org', 20), ('m.ththth.example.net', 5), ('example.net', 30)), x AS (SELECT page_id, host, rank, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS i FROM h JOIN r ON host = domain OR host LIKE '%.' || domain) SELECT h.page_id, h.host, x.rank FROM h LEFT JOIN x ON x.page_id = h.page_id AND i = 1")
def host_suffix_rank(spark, sf_dir):
    """The rank of the longest listed parent domain."""
    hosts = table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"))
    ranks = files.inline(spark, [("example.com", 10), ("example.org", 20), ("m.ththth.example.net", 5), ("example.net", 30)], "domain string, rank int")
    return joins.longest_suffix(hosts, "host", ranks, "domain", "rank").select("page_id", "host", "rank")


@query(f"WITH {HOSTS} SELECT page_id, host FROM h WHERE NOT (host = 'example.com' OR host LIKE '%.example.com' OR host LIKE '%.org' OR NOT contains(host, '.'))")
def blocklist_anti(spark, sf_dir):
    """Pages whose host and parents are on no list."""
    hosts = table(spark, sf_dir, "pages").select("page_id", text.host_of(F.col("url")).alias("host"))
    return joins.without_listed(hosts, "host", files.inline(spark, [("example.com",)], "domain string"), "domain", (".org",)).select("page_id", "host")


@query("SELECT page_id, CASE WHEN length(t) > 1500 THEN NULL WHEN regexp_matches(t, '(?i)just a moment|are you a robot') THEN 'human-check' END AS wall FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)")
def wall_detection(spark, sf_dir):
    """Pages that stand in for the page asked for."""
    plain = F.regexp_replace("html", "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", detect.wall(F.lit(""), plain).alias("wall"))


@query("SELECT event_id, CASE WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'missing' WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 'over' ELSE 'ok' END AS verdict FROM events")
def tag_validation(spark, sf_dir):
    """A rule over JSON answers: missing, out of range or fine."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.when(k.isNull(), "missing").when(k > 50, "over").otherwise("ok").alias("verdict"))


@query("SELECT o_orderkey, cast(round((o_totalprice * 0.5e-6 * 2 + o_custkey * 0.5e-6 * 10 + o_custkey * 0.5e-6 * 2 * 1.25) * 1e8) AS BIGINT) AS cost FROM orders WHERE o_orderstatus = 'F'")
def batch_costs(spark, sf_dir):
    """Cost of answers by a price table, in units of 1e-8."""
    price = tags.price_of(F.col("o_orderstatus"), [("^F", 2.0, 10.0)])
    cost = tags.batch_cost(F.col("o_totalprice"), F.col("o_custkey"), F.col("o_custkey"), F.lit(0), price)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(cost * 1e8).cast("long").alias("cost")).where("cost IS NOT NULL")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def changed_only(spark, sf_dir):
    """Documents whose content hash is not the one on record."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.where("doc_id % 3 = 0 AND doc_id % 2 <> 0").withColumn("hash", F.sha2(F.to_json(F.struct("text", "lang"), {"ignoreNullFields": "false"}), 256))
    return versions.changed_only(docs, known, ["doc_id"], ["text", "lang"]).select("doc_id")
