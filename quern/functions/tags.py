"""Checks of tagger answers against a taxonomy, and what answers cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sizes an answer must keep to.
MAX_STYLES, MAX_DESCRIPTION, MAX_PATTERNS = 4, 200, 8
ANSWER = "struct<block_type: string, page_role: string, style_tags: array<string>, industry: string, description: string, patterns: array<string>, has_price: string, has_reviews: string, has_video: string>"
FIELDS = ("block_type", "page_role", "style_tags", "industry", "description", "patterns", "has_price", "has_reviews", "has_video")


def tag_errors(answer: Column, taxonomy: dict[str, list[str]]) -> Column:
    """What is wrong with a JSON answer, in field order; an empty array if nothing is.

    ``taxonomy`` lists the words allowed for block_type, page_role, industry and style_tags.
    """
    keys = F.json_object_keys(answer)
    got = F.from_json(answer, ANSWER)
    wrong = [F.when(~F.array_contains(keys, f), F.lit(f"missing {f}")) for f in FIELDS]
    for f in ("block_type", "page_role", "industry"):
        wrong.append(F.when(F.array_contains(keys, f) & ~F.coalesce(got[f].isin(taxonomy[f]), F.lit(False)), F.lit(f"{f} is not in the taxonomy")))
    styles, text, patterns = got["style_tags"], got["description"], got["patterns"]
    given = lambda f: F.array_contains(keys, f)
    wrong += [
        F.when(given("style_tags") & styles.isNull(), "style_tags is not an array"),
        F.when((F.size(styles) < 1) | (F.size(styles) > MAX_STYLES), F.concat(F.lit(f"style_tags needs 1-{MAX_STYLES} tags, got "), F.size(styles).cast("string"))),
        F.when(F.exists(styles, lambda s: ~s.isin(taxonomy["style_tags"])), "style_tags holds a tag that is not in the taxonomy"),
        F.when(F.size(F.array_distinct(styles)) != F.size(styles), "style_tags repeats a tag"),
        F.when(given("description") & (F.coalesce(F.trim(text), F.lit("")) == ""), "description is empty"),
        F.when(text.rlike(r"[\r\n]"), "description is more than one line"),
        F.when(F.length(text) > MAX_DESCRIPTION, f"description is over {MAX_DESCRIPTION} characters"),
        F.when(given("patterns") & (patterns.isNull() | F.exists(patterns, lambda p: F.trim(p) == "")), "patterns must be non-empty strings"),
        F.when(F.size(patterns) > MAX_PATTERNS, f"patterns has more than {MAX_PATTERNS} entries"),
    ]
    wrong += [F.when(given(f) & ~F.coalesce(got[f].isin("true", "false"), F.lit(False)), f"{f} is not a boolean") for f in ("has_price", "has_reviews", "has_video")]
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, FIELDS)))), lambda k: F.concat(F.lit("unexpected field "), k))
    return F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(extra, F.array_compact(F.array(*wrong))))


def answer_outcome(kind: Column, stop_reason: Column, errors: Column, message: Column) -> Column:
    """status and error of one result: valid answers succeed, everything else fails with a reason."""
    status = F.when(kind != "succeeded", kind).when(stop_reason.isin("refusal", "max_tokens") | (F.size(errors) > 0), "invalid").otherwise("succeeded")
    error = (
        F.when(kind == "errored", F.coalesce(message, F.lit("unknown")))
        .when(kind == "expired", "expired before processing")
        .when(kind == "canceled", "batch canceled")
        .when(stop_reason == "refusal", "refusal")
        .when(stop_reason == "max_tokens", "hit max_tokens")
        .when(F.size(errors) > 0, F.array_join(errors, "; "))
    )
    return F.struct(status.alias("status"), error.alias("error"))


def price_of(model: Column, prices: list[tuple[str, float, float]]) -> Column:
    """input and output price per million tokens by the first pattern that fits; null if none does.

    Prices are a parameter: (pattern, input, output).
    """
    return F.coalesce(*[F.when(model.rlike(p), F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"))) for p, i, o in prices])


def batch_cost(tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column, price: Column, discount: float = 0.5, write: float = 1.25, read: float = 0.1) -> Column:
    """Cost of a batch answer in currency units."""
    rate = lambda p: p * discount / 1e6
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(tokens_in) * rate(price["input"]) + zero(cache_write) * rate(price["input"]) * write + zero(cache_read) * rate(price["input"]) * read + zero(tokens_out) * rate(price["output"])


def sent_size(width: Column, height: Column, most: int = 1568) -> Column:
    """width and height of an image as it is sent: scaled down to ``most`` on its longer side."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    grown = lambda x: F.greatest(F.floor(x * scale + 0.5), F.lit(1)).cast("int")
    return F.struct(grown(width).alias("width"), grown(height).alias("height"))


def image_tokens(width: Column, height: Column, per_token: int = 750) -> Column:
    return F.ceil(width * height / per_token).cast("long")


def text_tokens(chars: Column) -> Column:
    """About three characters a token."""
    return F.ceil(chars / 3).cast("long")


def estimate_request(system: Column, context: Column, width: Column, height: Column, expected: Column, price: Column, most: int = 1024) -> Column:
    """input and output tokens and cost of a request, at their upper end; ``system`` and ``context`` are in characters."""
    sent = sent_size(width, height)
    taken = text_tokens(system) + text_tokens(context) + image_tokens(sent["width"], sent["height"]) + 20
    given = F.least(F.lit(most), expected)
    return F.struct(taken.alias("input_tokens"), given.alias("output_tokens"), batch_cost(taken, given, F.lit(0), F.lit(0), price).alias("cost"))
