"""Ranking, quotas and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import prefix
from quern.operators.versions import first_per_key


#: Groups that quotas are shared out among; more are an error.
MOST_GROUPS = 10_000


def evidence_tier(strong: Column) -> Column:
    """0 for three strong signals or more, 1 for two, 2 otherwise."""
    return F.when(strong >= 3, 0).when(strong == 2, 1).otherwise(2)


def evidence_order(strong: str, rank: str, mentions: str, host: str) -> list[Column]:
    """Seeds by tier, traffic rank, mentions and host."""
    return [evidence_tier(F.col(strong)), F.asc_nulls_last(rank), F.desc(mentions), F.asc(host)]


def candidate_order(rank: str, mentions: str, sources: str, host: str) -> list[Column]:
    """Ranked hosts by rank; the others by mentions, number of sources and host."""
    unranked = F.col(rank).isNull()
    return [F.asc_nulls_last(rank), F.when(unranked, -F.col(mentions)), F.when(unranked, -F.size(sources)), F.asc(host)]


def claim_order(priority: str, rank: str, host: str) -> list[Column]:
    """What a queue hands out next: priority, then ranked before unranked."""
    return [F.desc(priority), F.col(rank).isNull().cast("int"), F.asc(rank), F.asc(host)]


def in_tiers(df: DataFrame, tiers: list[Column], seq: str) -> DataFrame:
    """Rows by the first tier whose condition holds, stable within a tier."""
    tier = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers)], F.lit(len(tiers)))
    return df.withColumn("tier", tier).orderBy("tier", seq)


def round_robin(df: DataFrame, lane: str, order: list[Column], limit: int | None = None, name: str = "pick") -> DataFrame:
    """Rows taken in turn from lanes, larger lanes first, the best of a lane first.

    ``pick`` numbers what was taken: by a window over the limited rows, by ranges where there is no limit.
    """
    place = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    sizes = df.groupBy(lane).agg(F.count("*").alias("__size"))
    rows = df.withColumn("__place", place)
    if limit is not None:
        rows = rows.where(F.col("__place") <= limit)
    rows = rows.join(sizes, rows[lane].eqNullSafe(sizes[lane])).drop(sizes[lane])
    turn = [F.asc("__place"), F.desc("__size"), F.asc(lane)]
    if limit is None:
        return prefix.numbered(rows, turn, name).drop("__place", "__size")
    return rows.orderBy(*turn).limit(limit).withColumn(name, F.row_number().over(Window.orderBy(*turn))).drop("__place", "__size")


def quotas(sizes: dict[str, int], total: int, least: int = 1) -> dict[str, int]:
    """Shares of ``total`` in proportion to group sizes.

    Groups whose share would be below ``least`` get it; the rest is shared out
    anew; what rounding leaves goes to the largest fractions, ties by name.
    """
    total = min(total, sum(sizes.values()))
    fixed: dict[str, int] = {}
    while True:
        rest = {k: n for k, n in sizes.items() if k not in fixed}
        left, weight = total - sum(fixed.values()), sum(rest.values())
        low = [k for k, n in rest.items() if weight and left * n / weight < least]
        if not low:
            break
        fixed |= {k: min(least, sizes[k]) for k in low}
    shares = {k: left * n / weight for k, n in rest.items()} if weight else {}
    out = {k: int(s) for k, s in shares.items()}
    for k in sorted(shares, key=lambda k: (out[k] - shares[k], k))[: max(0, left - sum(out.values()))]:
        out[k] += 1
    return fixed | out


def quota_sample(df: DataFrame, group: str, order: list[Column], total: int, least: int = 1) -> DataFrame:
    """The first rows of each group, as many as its quota. Group sizes come from one small aggregate."""
    counted = df.groupBy(group).count().limit(MOST_GROUPS + 1).collect()
    if len(counted) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups in {group}: quotas are shared out on the driver")
    sizes = {r[0]: r[1] for r in counted}
    share = quotas(sizes, total, least)
    most = F.create_map(*[F.lit(x) for kv in share.items() for x in kv]) if share else F.create_map().cast("map<string,int>")
    ranked = df.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("__place") <= F.try_element_at(most, F.col(group))).drop("__place")


def stratified(df: DataFrame, distinct: list[str], strata: list[str], row_id: str, limit: int) -> DataFrame:
    """Distinct rows, drawn in turn from strata in the order of their id's SHA-256 (W11). Deterministic."""
    one = first_per_key(df, distinct, [F.sha2(F.col(row_id).cast("string"), 256), F.col(row_id)])
    rows = one.withColumn("__stratum", F.concat_ws("\u0001", *strata)).withColumn("__draw", F.sha2(F.col(row_id).cast("string"), 256))
    return round_robin(rows, "__stratum", [F.asc("__draw"), F.asc(row_id)], limit).drop("__stratum", "__draw")


def capped_prefix(df: DataFrame, order: list[Column], cost: str, committed: float, cap: float, group: list[str] | None = None) -> DataFrame:
    """Rows accepted in order while what is committed and their running cost stay within the cap.

    Costs are whole numbers or decimals and not negative, so the running sum never
    comes back under the cap. Neither a group nor the whole table is one task's.
    """
    rows = prefix.running(df, order, {"running": F.col(cost)}, group)
    return rows.withColumn("accepted", F.lit(committed) + F.col("running") <= cap)


def one_per_host(df: DataFrame, host: str, score: str, row_id: str, limit: int = 12) -> DataFrame:
    """The best row of each host, best first."""
    return first_per_key(df, [host], [F.desc(score), F.asc(row_id)]).orderBy(F.desc(score), row_id).limit(limit)


def block_similarity(target: dict, colour: Column, page_type: Column, platform: Column, ratio: Column) -> Column:
    """4 for the colour, 2 for the page type, 1 for the platform, and up to 1 for the shape (H20, A.15)."""
    same = lambda c, k, w: F.when(c == F.lit(target[k]), float(w)).otherwise(0.0)
    shape = F.greatest(F.lit(0.0), 1 - F.abs(F.log2(ratio / F.lit(target["ratio"]))))
    return same(colour, "colour", 4) + same(page_type, "page_type", 2) + same(platform, "platform", 1) + F.coalesce(shape, F.lit(0.0))


def similar_pages(pages: DataFrame, target: dict, limit: int = 12) -> DataFrame:
    """The first page with blocks of each other store of the same page type, scored by store facts (W14, A.15)."""
    rows = pages.where((F.col("page_type") == target["page_type"]) & (F.col("host") != target["host"]) & (F.col("blocks") > 0))
    first = first_per_key(rows, ["host"], [F.asc("seq")])
    points = lambda c, w: F.when(F.col(c) == F.lit(target[c]), w).otherwise(0.0)
    scored = first.withColumn("score", points("industry", 4.0) + points("platform", 2.0) + points("theme", 1.0) + points("country", 0.5))
    return scored.orderBy(F.desc("score"), F.asc_nulls_last("rank"), "host").limit(limit)


def next_queries(df: DataFrame, priority: Column, order: list[Column], limit: int) -> DataFrame:
    """Rows by a priority, then an order, cut to a limit."""
    return df.orderBy(priority, *order).limit(limit)
