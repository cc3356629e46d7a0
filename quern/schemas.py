"""Explicit schemas of the tables and documents; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_VIEW = "struct<file: string, width: int, fullHeight: int, strategy: string, status: int, ms: int, error: string>"
_BLOCK = "struct<ref: string, index: int, typeHint: string, parentType: string, tag: string, id: string, classes: string, top: double, height: double, width: double, text: string, textLength: int, headline: string, buttons: int, images: int, videos: int, bg: string, viewport: string, file: string, error: string>"

MANIFEST = f"""
site struct<host: string, origin: string, platform: string, theme: string, builder: string, apps: array<string>, currency: string, locale: string>,
page struct<url: string, type: string, slug: string, capturedAt: string, title: string, description: string, canonical: string, ogImage: string, lang: string, h1: string>,
viewports struct<desktop: {_VIEW}, mobile: {_VIEW}>,
blocks array<{_BLOCK}>
"""
SIDECAR = "images map<string, struct<width: int, height: int, webpKey: string, thumbnailKey: string, blurhash: string, slices: array<struct<index: int, key: string, top: int, width: int, height: int>>>>"
SITES = "host string, platform string, builder string, theme string, theme_version string, apps array<string>, currency string, locale string, country string, industry string, industry_score float, rank int, mentions int, sources array<string>, brand string, title string"
PAGES = "page_id string, host string, url string, page_type string, slug string, title string, description string, canonical string, og_image string, lang string, h1 string"
CAPTURES = "capture_id string, page_id string, captured_at timestamp"
BLOCKS = "id string, capture_id string, viewport string, block_index int, type_hint string, block_type string, tags array<string>, top int, height int, width int, text string, headline string, buttons int, images int, videos int, background string, file string, embedding array<float>"
TECH = "host string, kind string, name string, version string"
TERMS = "term string, docs bigint"
BATCHES = "batch_id string, status string, run_label string, submitted_at timestamp, estimated_cost decimal(12,6)"
REQUESTS = "batch_id string, custom_id string, block_id string, status string, model string, input_tokens bigint, output_tokens bigint, cost decimal(12,6), submitted_at timestamp"
VERDICTS = "host string, ok boolean, reason string, signals struct<strong: int, weak: int>, platform string, checked_at timestamp"
CANDIDATES = "host string, source string, source_url string, brand string, industry_hint string, platform_hint string, seq bigint"
SUBSCRIPTION_EVENTS = "event_id string, arrival bigint, user_id string, subscription string, status string, price string, quantity int, occurred_at bigint, relevant boolean"
SEED_COLUMNS = ("host", "final_host", "brand", "title", "platform", "builder", "theme", "theme_version", "currency", "country", "locale", "industry", "industry_score", "industry_runner_up", "apps", "collections", "store_signals", "strong_signals", "tranco_rank", "mentions", "sources", "validated_at")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def assert_schema(df: DataFrame, ddl: str) -> DataFrame:
    """The frame itself; raises if a column is missing or has another type. Extra columns are allowed."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} is not {f.dataType}" for f in struct(ddl) if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError("; ".join(wrong))
    return df
