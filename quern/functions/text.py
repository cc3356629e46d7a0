"""String, URL and key expressions. All of them are native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed


def js_round(x: Column) -> Column:
    """Round half up, towards positive infinity (P3): -2.5 becomes -2."""
    return F.floor(x + 0.5).cast("long")


def clean(text: Column) -> Column:
    """Text without NUL characters."""
    return F.translate(text, "\u0000", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without ``www.``; null if there is none that looks like a domain."""
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", "")
    proto = F.try_parse_url(full, F.lit("PROTOCOL"))
    return F.when(proto.isin("http", "https") & host.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), host)


def host_line(line: Column) -> Column:
    """A line of a host list: scheme, ``www.``, path and comment go; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"#.*$", ""))), r"^https?://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"[/\s].*$", "")
    return F.nullif(bare, F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first, as far as two labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def url_path(url: Column) -> Column:
    """Path without closing slashes; '/' at the top."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_replace(path, r"/+$", ""), F.lit("")), F.lit("/"))


def _type_of(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(p), F.lit(t)) for p, t in fixed.PAGE_TYPE_PATTERNS], F.lit("other"))


def page_type(url: Column) -> Column:
    """Page type by path; where the path says nothing, without a region prefix."""
    path = url_path(url)
    bare = F.coalesce(F.nullif(F.regexp_replace(path, fixed.LOCALE_PREFIX, ""), F.lit("")), F.lit("/"))
    plain = _type_of(path)
    return F.when((plain == "other") & path.rlike(fixed.LOCALE_PREFIX), _type_of(bare)).otherwise(plain)


def slugify(text: Column, empty: str = "block") -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.coalesce(F.nullif(F.lower(bare), F.lit("")), F.lit(empty))


def page_slug(url: Column) -> Column:
    """Slug of the path and six hex digits of the query's SHA-1; 80 characters at most."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/+|/+$", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(path, r"(?i)[^a-z0-9]+", "-"), r"^-|-$", ""))
    slug = F.when(path == "", F.lit("home")).otherwise(slug)
    query = F.try_parse_url(url, F.lit("QUERY"))
    tail = F.when(F.length(query) > 0, F.concat(F.lit("-"), F.substring(F.sha1(F.concat(F.lit("?"), query)), 1, 6))).otherwise(F.lit(""))
    return F.coalesce(F.nullif(F.substring(F.concat(slug, tail), 1, 80), F.lit("")), F.lit("home"))


def section_of(block_type: Column, hint: Column | None = None) -> Column:
    """Section: the type (else the hint) without ``-part``."""
    kind = F.coalesce(block_type, hint) if hint is not None else block_type
    return F.regexp_replace(kind, r"-part$", "")


def section_hint(declared: Column, element_id: Column, tag: Column, classes: Column) -> Column:
    """Section type of an element from what it declares, its id, its tag, or words in its classes."""
    template = F.regexp_extract(element_id, r"^shopify-section-(?:template--\d+__|sections--\d+__)?(.+)$", 1)
    template = F.regexp_replace(F.regexp_replace(F.regexp_replace(template, r"_[A-Za-z0-9]{6,}$", ""), r"[-_]?\d+$", ""), "_", "-")
    words = F.concat_ws(" ", F.lower(classes), F.lower(element_id))
    by_tag = F.when(F.lower(tag).isin("header", "footer"), F.lower(tag)).when(F.lower(tag) == "nav", F.lit("navigation"))
    by_word = [F.when(words.contains(w), F.lit(w)) for w in fixed.SECTION_WORDS]
    return F.coalesce(F.nullif(F.lower(declared), F.lit("")), F.when(element_id.startswith("shopify-section-"), F.nullif(F.lower(template), F.lit(""))), by_tag, *by_word, F.lit("unknown"))


def label(value: Column, names: dict[str, str]) -> Column:
    """Display name of a key; a key without one names itself (P10)."""
    if not names:
        return value
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), value)


def ranked_in(value: Column, order: tuple[str, ...], last: int = 99) -> Column:
    """Place of a value in a fixed order, ``last`` if it is not there."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.coalesce(F.nullif(at, F.lit(0).cast("long")), F.lit(last).cast("long")).cast("int")


def block_context(parts: dict[str, Column]) -> Column:
    """Canonical lines ``name: value`` of what is set, white space collapsed."""
    lines = [F.when(F.length(one_line(c.cast("string"))) > 0, F.concat(F.lit(f"{n}: "), one_line(c.cast("string")))) for n, c in parts.items()]
    return F.concat_ws("\n", *lines)


def embedding_input(kind: Column, description: Column, headline: Column, body: Column, most: int = 2000) -> Column:
    """``<kind> block. <description, or headline. text>`` cut to ``most`` characters."""
    told = F.coalesce(F.nullif(F.trim(description), F.lit("")), F.concat_ws(". ", F.nullif(F.trim(headline), F.lit("")), F.nullif(F.trim(body), F.lit(""))))
    return F.substring(F.concat(kind, F.lit(" block. "), told), 1, most)


def from_the_right(forwarded: Column, hops: int = 1) -> Column:
    """The address ``hops`` from the right of a forwarding list."""
    return F.trim(F.try_element_at(F.split(forwarded, ","), F.lit(-hops)))


def sorted_query(query: Column) -> Column:
    """Query parameters in order, so equal requests have equal keys."""
    return F.array_join(F.array_sort(F.split(query, "&")), "&")


def uuid_code(plain: Column) -> Column:
    return F.replace(plain, F.lit("-"), F.lit(""))


def uuid_decode(code: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(code, a, n) for a, n in cuts])


def base64url(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(data), "+/\n\r", "-_"), "=+$", "")


def unbase64url(code: Column) -> Column:
    return F.unbase64(F.translate(code, "-_", "+/"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def brief(kind: Column, facts: dict[str, Column], headline: Column, body: Column, most: int = 600) -> Column:
    """A brief of a block from its facts (P12): what it is, what it says, and what it has, one line each."""
    has = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"))) for name, n in facts.items()]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("A "), F.replace(kind, F.lit("-"), F.lit(" ")), F.lit(" block.")),
        F.when(F.length(one_line(headline)) > 0, F.concat(F.lit("Headline: "), one_line(headline))),
        F.when(F.length(one_line(body)) > 0, F.concat(F.lit("Copy: "), F.substring(one_line(body), 1, most))),
        F.nullif(F.concat(F.lit("It has "), F.nullif(F.concat_ws(", ", *has), F.lit("")), F.lit(".")), F.lit("")),
    )


def shot_of(image: Column, file: Column) -> Column:
    """The thumbnail of an image struct, else the file itself (P5)."""
    return F.coalesce(image["thumbnailKey"], file)


def is_uuid(column: Column) -> Column:
    """Whether a text is a UUID (F23); false for null."""
    return F.coalesce(column.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def decoded(column: Column) -> Column:
    """Character references as characters: the usual named ones, and decimal ones of ASCII."""
    out = F.regexp_replace(column, "&#0*39;", "'")
    for code in (32, 34, 38, 45, 124):
        out = F.regexp_replace(out, f"&#0*{code};", chr(code))
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("ndash", "\u2013"), ("mdash", "\u2014"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def html_title(html: Column) -> Column:
    """The title of a page on one line; null if there is none."""
    return F.nullif(one_line(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def html_description(html: Column) -> Column:
    """The description a page gives of itself, by name or by property; null if there is none."""
    ways = (r"""(?is)<meta[^>]+name=["']description["'][^>]*content=["']([^"']*)""", r"""(?is)<meta[^>]+property=["']og:description["'][^>]*content=["']([^"']*)""")
    return F.coalesce(*[F.nullif(one_line(decoded(F.regexp_extract(html, w, 1))), F.lit("")) for w in ways])


def platform_family(platform: Column) -> Column:
    """Variants of one platform as one family."""
    low = F.lower(F.coalesce(F.nullif(platform, F.lit("")), F.lit("unknown")))
    return F.when(low.startswith("squarespace"), "squarespace").when(low.startswith("wix"), "wix").when(low == "wordpress", "woocommerce").otherwise(low)


def lane_for(hint: Column) -> Column:
    """Which of the two request lanes a site takes."""
    return F.when(F.lower(F.coalesce(hint, F.lit(""))).contains("shopify"), "shopify").otherwise("other")


def limit_key(kind: str, value: Column) -> Column:
    """A counter's key: the kind and a short hash, never the value itself."""
    return F.concat(F.lit(f"{kind}:"), F.substring(base64url(F.unhex(F.sha2(F.lower(F.trim(value)), 256))), 1, 22))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def page_key(block_id: Column, host: Column, url: Column) -> Column:
    """The page part of a block id of more than two steps, else host and address."""
    steps = F.split(block_id, "/")
    return F.when(F.size(steps) > 2, F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 2, F.lit(0))), "/")).otherwise(F.concat_ws(" ", host, url))


def position_of(block_id: Column) -> Column:
    """The number in a block id's last step, 0 if it is none."""
    return F.coalesce(F.substring_index(block_id, "/", -1).try_cast("int"), F.lit(0))
