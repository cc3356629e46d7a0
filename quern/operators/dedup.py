"""De-duplication by rank within a section, and first-seen rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import fixed, text
from quern.operators.versions import first_per_key


def section_order(page_type: Column, kind: Column, url: Column, index: Column, row_id: Column) -> list[Column]:
    """Which block of a section is shown: page rank, whole before part, url, index, id (A.1)."""
    return [text.ranked_in(page_type, fixed.WALL_PAGES), kind.endswith("-part").cast("int"), url, index, row_id]


def shown_per_section(blocks: DataFrame, host: str = "host", view: str = "viewport", page_type: str = "page_type", block_type: str = "block_type", hint: str = "type_hint", url: str = "url", index: str = "block_index", row_id: str = "id") -> DataFrame:
    """One block per host, viewport and section (W1). It runs before any filter."""
    kind = F.coalesce(F.col(block_type), F.col(hint))
    rows = blocks.withColumn("section", text.section_of(kind))
    return first_per_key(rows, [host, view, "section"], section_order(F.col(page_type), kind, F.col(url), F.col(index), F.col(row_id)))


def shown_in_order(blocks: DataFrame, seq: str, exempt: Column | None = None, **columns: str) -> DataFrame:
    """As :func:`shown_per_section`, in input order; exempt rows all stay."""
    if exempt is None:
        return shown_per_section(blocks, **columns).orderBy(seq)
    free = F.coalesce(exempt, F.lit(False))
    kept = shown_per_section(blocks.where(~free), **columns)
    return kept.unionByName(blocks.where(free).withColumn("section", F.lit(None).cast("string")), allowMissingColumns=True).orderBy(seq)


def first_by_target(df: DataFrame, target: str, seq: str, limit: int | None = None) -> DataFrame:
    """The first of the rows that lead to one target, up to a limit in order."""
    kept = first_per_key(df, [target], [F.asc(seq)]).orderBy(seq)
    return kept.limit(limit) if limit is not None else kept


def first_n_per_type(df: DataFrame, kind: str, seq: str, limits: dict[str, int], drop: Column | None = None) -> DataFrame:
    """The first rows of each type in order, as many as its limit."""
    from pyspark.sql.window import Window

    rows = df.where(~F.coalesce(drop, F.lit(False))) if drop is not None else df
    rows = rows.where(F.col(kind).isin([*limits]))
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(kind).orderBy(seq)))
    return ranked.where(F.col("__n") <= F.element_at(most, F.col(kind))).drop("__n")


def preferred_then_fill(preferred: DataFrame, fill: DataFrame, key: str, seq: str, limit: int) -> DataFrame:
    """Preferred rows first, then others until there are enough, no key twice."""
    both = preferred.withColumn("__p", F.lit(0)).unionByName(fill.withColumn("__p", F.lit(1)))
    kept = first_per_key(both, [key], [F.asc("__p"), F.asc(seq)])
    return kept.orderBy("__p", seq).limit(limit).drop("__p")
