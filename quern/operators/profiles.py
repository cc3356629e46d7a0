"""Store profiles: pages, flows, cards and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions.text import ranked_in
from quern.operators.aggregates import mode_first_seen


def pages_from_blocks(blocks: DataFrame, keys: list[str], seq: str, at: str, view: str, first: list[str]) -> DataFrame:
    """A page per group: facts of its first block, latest date, counts and ordered ids per view."""
    in_view = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col(view) == v, F.struct(seq, "id")))), lambda s: s["id"])
    return blocks.groupBy(*keys).agg(*[F.min_by(c, seq).alias(c) for c in first], F.max(at).alias("captured_at"), F.count("*").alias("blocks"), in_view("desktop").alias("desktop"), in_view("mobile").alias("mobile"))


def flows(pages: DataFrame, host: str = "host", kind: str = "page_type", has_content: Column | None = None, steps: tuple[str, ...] = fixed.FLOW_STEPS, required: tuple[str, ...] = fixed.FLOW_REQUIRED) -> DataFrame:
    """Per store: steps it has, required ones it lacks, pages captured, whether complete."""
    rows = pages.where(has_content) if has_content is not None else pages
    literal = lambda xs: F.array(*map(F.lit, xs))
    out = rows.groupBy(host).agg(F.collect_set(kind).alias("__kinds"), F.count("*").alias("captured"))
    return out.select(
        host,
        F.array_intersect(literal(steps), "__kinds").alias("steps"),
        F.array_except(literal(required), "__kinds").alias("missing"),
        "captured",
        (F.size(F.array_except(literal(required), "__kinds")) == 0).alias("complete"),
    )


def flow_order(complete: str = "complete", steps: str = "steps", rank: str = "rank", brand: str = "brand") -> list[Column]:
    return [F.desc(complete), F.size(steps).desc(), F.asc_nulls_last(rank), F.asc(brand)]


def flow_totals(flows_: DataFrame) -> DataFrame:
    return flows_.agg(F.count("*").alias("stores"), F.count_if("complete").alias("complete"), F.coalesce(F.sum("captured"), F.lit(0)).alias("captured"))


def captures_of(pages: DataFrame, at: str = "captured_at") -> DataFrame:
    """Pages per capture date; pages without a date are a group too."""
    return pages.groupBy(at).agg(F.count("*").alias("pages")).orderBy(F.desc_nulls_last(at))


def store_from_blocks(blocks: DataFrame, host: str, seq: str, facts: list[str], apps: str) -> DataFrame:
    """A store pieced together from its blocks: modes of facts, union of apps."""
    out = blocks.groupBy(host).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(apps)))).alias(apps))
    for fact in facts:
        out = out.join(mode_first_seen(blocks, [host], fact, seq).drop("n"), host, "left")
    return out


def site_cards(stores: DataFrame, pages: DataFrame, host: str = "host") -> DataFrame:
    """Listed and captured stores with page and block counts and a cover page."""
    cover = F.struct(ranked_in(F.col("page_type"), fixed.PROFILE_PAGES), F.col("url"))
    facts = pages.groupBy(host).agg(F.count("*").alias("pages"), F.sum("blocks").alias("blocks"), F.min_by("url", cover).alias("cover"))
    listed = stores.withColumn("listed", F.lit(True))
    return listed.join(facts, host, "full_outer").withColumn("listed", F.coalesce("listed", F.lit(False))).fillna(0, ["pages", "blocks"])


def latest_pages(pages: DataFrame, captures: DataFrame, blocks: DataFrame, host: str = "host") -> DataFrame:
    """Per store its pages at their latest capture with block counts, by type and URL."""
    newest = captures.groupBy("page_id").agg(F.max_by("capture_id", "captured_at").alias("capture_id"), F.max("captured_at").alias("captured_at"))
    counts = blocks.groupBy("capture_id").agg(F.count("*").alias("blocks"))
    rows = pages.join(newest, "page_id").join(counts, "capture_id", "left").fillna(0, ["blocks"])
    return rows.groupBy(host).agg(F.array_sort(F.collect_list(F.struct("page_type", "url", "page_id", "captured_at", "blocks"))).alias("pages"))


def brand_of(titles: DataFrame, host: str, title: str, seq: str) -> DataFrame:
    """Brand by the most frequent last part of a store's titles."""
    tail = F.trim(F.element_at(F.split(title, r"\s[|–—-]\s"), -1))
    tails = titles.where(F.col(title).rlike(r"\s[|–—-]\s")).withColumn("brand", tail)
    return mode_first_seen(tails, [host], "brand", seq).drop("n")


def store_row(sites: DataFrame) -> DataFrame:
    """Site rows as stores: the brand falls back to the host."""
    return sites.withColumn("brand", F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.col("host")))


def tech_rows(sites: DataFrame, host: str = "host", named: tuple[tuple[str, str | None], ...] = (("platform", None), ("builder", None), ("theme", "theme_version")), apps: str = "apps") -> DataFrame:
    """(host, kind, name, version) of what is set."""
    facts = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("name"), (F.col(v) if v else F.lit(None).cast("string")).alias("version")) for k, v in named]
    more = F.transform(F.coalesce(F.col(apps), F.array().cast("array<string>")), lambda a: F.struct(F.lit("app").alias("kind"), a.alias("name"), F.lit(None).cast("string").alias("version")))
    rows = sites.select(host, F.explode(F.concat(F.array(*facts), more)).alias("t")).select(host, "t.kind", "t.name", "t.version")
    return rows.where(F.coalesce(F.col("name"), F.lit("")) != "")
