"""Detection and classification expressions over a page's HTML or text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.colour import named
from quern.functions.text import any_of


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def platform(html: Column) -> Column:
    """Shop or site platform, first match wins; null if none shows."""
    low = F.lower(html)
    all_of = lambda marks: reduce(lambda a, b: a & b, map(low.contains, marks))
    any_of_ = lambda tests: reduce(lambda a, b: a | b, tests)
    found = []
    for groups, name, second in fixed.PLATFORM_MARKS:
        named_ = F.when(any_of_(map(low.contains, second[1:])), F.lit(second[0])).otherwise(F.lit(name)) if second else F.lit(name)
        found.append(F.when(any_of_(map(all_of, groups)), named_))
    return F.coalesce(*found)


def fingerprint(html: Column) -> Column:
    """platform, builder, theme, theme_version, currency, country and locale as one struct."""
    low, kind = F.lower(html), platform(html)
    hosted, press = kind == "shopify", kind.isin("wordpress", "woocommerce")
    theme = _found(html, fixed.THEME_OBJECT)
    builders = F.coalesce(*[F.when(low.contains(mark), F.lit(name)) for mark, name in fixed.BUILDER_MARKS])
    own = lambda patterns: F.coalesce(F.when(hosted, _found(html, patterns[0])), _found(html, patterns[1]))
    return F.struct(
        kind.alias("platform"),
        F.when(hosted, builders).when(press & low.contains("elementor"), F.lit("elementor")).alias("builder"),
        F.when(hosted, F.coalesce(*[_found(theme, p) for p in fixed.THEME_NAMES])).when(press, _found(low, fixed.THEME_FOLDER)).alias("theme"),
        F.when(hosted, _found(theme, fixed.THEME_VERSION)).alias("theme_version"),
        own(fixed.CURRENCIES).alias("currency"),
        F.when(hosted, _found(html, fixed.COUNTRY)).alias("country"),
        own(fixed.LOCALES).alias("locale"),
    )


def apps(html: Column, patterns: tuple[tuple[str, str], ...] = fixed.APP_PATTERNS) -> Column:
    """Names of the apps whose pattern is found, in list order."""
    return F.array_compact(F.array(*[F.when(html.rlike(f"(?i){p}"), F.lit(n)) for n, p in patterns]))


def signal_count(html: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(html)
    return sum((low.contains(m).cast("int") for m in marks), F.lit(0))


def _headline(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def title_says_store(title: Column, description: Column) -> Column:
    return _headline(title, description).rlike(f"(?i){fixed.STORE_TITLE}")


def is_spam(title: Column, description: Column) -> Column:
    return _headline(title, description).rlike(f"(?i){fixed.SPAM_TITLE}")


def looks_like_store(kind: Column, strong: Column, weak: Column, title: Column, description: Column, sources: Column) -> Column:
    """The store verdict over detected facts (A.10)."""
    listed = F.coalesce(F.arrays_overlap(sources, F.array(*map(F.lit, fixed.STORE_SOURCES))), F.lit(False))
    says = title_says_store(title, description)
    sells = F.coalesce(kind.isin(*fixed.STORE_PLATFORMS), F.lit(False))
    on_shop = (strong >= 1) | (weak >= 2) | listed | says
    elsewhere = any_of([strong >= 2, (strong >= 1) & (weak >= 2), weak >= 4, says & ((strong >= 1) | (weak >= 1) | listed), listed & (strong >= 1)])
    return ~is_spam(title, description) & F.when(sells, on_shop).otherwise(elsewhere)


def parked(html: Column) -> Column:
    """The first mark of a parked domain; small-page marks only count up to 20,000 characters."""
    low = F.lower(html)
    first = F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in fixed.PARKED_MARKS])
    return F.when(~(first.isin(*fixed.SMALL_PAGE_MARKS) & (F.length(html) > 20_000)), first)


def adult(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(m), F.lit(m)) for m in fixed.ADULT_MARKS])


def wall(title: Column, text: Column) -> Column:
    """Kind of a page that stands in for the one asked for; only short texts can be one."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    hay = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), body)
    return F.when(F.length(body) <= 1500, F.coalesce(*[F.when(hay.rlike(f"(?i){p}"), F.lit(k)) for k, p in fixed.WALL_PATTERNS]))


def rejection(status: Column, is_html: Column, html: Column, title: Column, description: Column, is_store: Column) -> Column:
    """First reason to reject a fetched page, null if there is none."""
    return F.coalesce(
        F.when(status.isNull(), F.lit("dead")),
        F.when((status < 200) | (status >= 400), F.concat(F.lit("http-"), status.cast("string"))),
        F.when(~is_html, F.lit("not-html")),
        F.when(is_spam(title, description), F.lit("spam")),
        F.when(parked(html).isNotNull() | (F.length(html) < 1500), F.lit("parked")),
        F.when(~is_store, F.lit("not-store")),
        F.when(adult(F.concat_ws(" ", title, description)).isNotNull(), F.lit("adult")),
    )


def hold_back(listed_reason: Column, title: Column, description: Column, final_host: Column, coming_soon: Column, strong: Column) -> Column:
    """First reason to hold a seed back."""
    return F.coalesce(
        listed_reason,
        F.when(is_spam(title, description), F.lit("spam")),
        F.when(final_host.rlike(f"(?i){fixed.ELSEWHERE_HOSTS}"), F.lit("forwards elsewhere")),
        F.when(coming_soon & (strong == 0), F.lit("coming soon")),
    )


def failure_kind(reason: Column) -> Column:
    """``browser``, ``transient`` or ``final`` (F19); null stays null."""
    return F.when(reason.rlike(f"(?i){fixed.BROWSER_GONE}"), "browser").when(reason.rlike(f"(?i){fixed.TRANSIENT}"), "transient").when(reason.isNotNull(), "final")


def robots_verdict(status: Column, path: Column, listed: Column, allowed: Column) -> Column:
    """What robots.txt means for a path, by how its fetch ended (F27); the block list goes first."""
    careful = path.rlike(r"^/(cart|checkout|account|login|admin|search)")
    return (
        F.when(listed, "blocked")
        .when(status.isNull(), "dead")
        .when(status.between(200, 299), F.when(allowed, "allow").otherwise("deny"))
        .when(status == 429, F.when(careful, "deny").otherwise("allow"))
        .when(status.between(400, 499), "allow")
        .otherwise("deny")
    )


def redirect_outcome(final_url: Column, host: Column, final_host: Column, blocks: Column) -> Column:
    """skipped or failed with its reason, or null, after a capture."""
    return F.coalesce(
        F.when(final_url.rlike(r"/password/?($|\?)"), F.lit("skipped: password page")),
        F.when((final_host != host) & final_host.rlike(f"(?i){fixed.ELSEWHERE_HOSTS}"), F.concat(F.lit("skipped: forwards to "), final_host)),
        F.when(blocks == 0, F.lit("failed: no content")),
    )


def country(host: Column, currency: Column, locale: Column, visitor: Column, own: str = "XK") -> Column:
    """Where a site is from: domain ending, currency, locale, then what it shows a visitor."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    endings = table(fixed.ENDING_COUNTRY)
    return F.coalesce(
        F.try_element_at(endings, F.substring_index(host, ".", -2)),
        F.try_element_at(endings, F.substring_index(host, ".", -1)),
        F.try_element_at(table(fixed.CURRENCY_COUNTRY), currency),
        F.when(locale.rlike(r"-[A-Za-z]{2}$"), F.upper(F.right(locale, F.lit(2)))),
        F.when(visitor != own, visitor),
    )


def spaced(text: Column) -> Column:
    """Lower-case text of the characters that keywords have, blanks around and between."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9&+\-' ]+", " "), F.lit(" "))


def keyword_hits(low: Column, words: list[str], most: int = 12) -> Column:
    """Non-overlapping occurrences of the words in a spaced text, one cap for all of them (A.11)."""
    counts = [((F.length(low) - F.length(F.replace(low, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int") for w in words]
    return F.least(sum(counts, F.lit(0)), F.lit(most))


def industry(buckets: list[tuple[Column, float]], keywords: dict[str, list[str]], least: float = 3.0) -> Column:
    """industry, score and runner_up by weighted keyword hits; ``other`` below ``least``.

    ``keywords`` maps an industry to its words. Ties go to the industry that an
    earlier bucket scored first, then to the one named first.
    """
    names = list(keywords)
    hits = F.array(*[named(spaced(t), lambda low: F.array(*[keyword_hits(low, w) for w in keywords.values()])) for t, _ in buckets])

    def ranked(h: Column) -> Column:
        scored = []
        for i, k in enumerate(names):
            mine = [F.get(F.get(h, n), i) for n in range(len(buckets))]
            score = sum((x.cast("double") * weight for x, (_, weight) in zip(mine, buckets, strict=True)), F.lit(0.0))
            first = F.coalesce(*[F.when(x > 0, F.lit(n * len(names) + i)) for n, x in enumerate(mine)])
            scored.append(F.when(first.isNotNull(), F.struct((-score).alias("s"), first.alias("f"), F.lit(k).alias("k"))))
        return F.array_sort(F.array_compact(F.array(*scored)))

    def verdict(r: Column) -> Column:
        top, next_ = F.get(r, 0), F.get(r, 1)
        score = F.coalesce(-top["s"], F.lit(0.0))
        won = score >= least
        fields = {"industry": F.when(won, top["k"]).otherwise("other"), "score": score, "runner_up": F.when(won, next_["k"]).otherwise(top["k"])}
        return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])

    return named(hits, lambda h: named(ranked(h), verdict))


def probe(html: Column) -> Column:
    """platform, signals and store of a quick look at a page."""
    low = F.lower(html)
    kind = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [low.contains(m) for m in marks]), F.lit(name)) for marks, name in fixed.PROBE_PLATFORMS])
    signals = signal_count(html, fixed.PROBE_SIGNALS)
    return F.struct(kind.alias("platform"), signals.alias("signals"), (F.coalesce(kind.isin(*fixed.PROBE_STORES), F.lit(False)) | (signals >= 3)).alias("store"))
