"""Pages of a sorted table. Orders must be total, so that each row is on exactly one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clamp(limit, offset, default: int = 60, most: int = 200) -> tuple[int, int]:
    """limit in 1..most and offset >= 0 from request values (A.4): 0 and what is no number become the default."""

    def number(x) -> int:
        try:
            return int(float(x))
        except (TypeError, ValueError):
            return 0

    return min(most, max(1, number(limit) or default)), max(0, number(offset))


def page(df: DataFrame, order: list[Column], limit=None, offset=None) -> DataFrame:
    """One page by offset (O1, O2)."""
    n, at = clamp(limit, offset)
    return df.orderBy(*order).offset(at).limit(n)


def next_cursor(offset: int, length: int, total: int) -> int | None:
    return offset + length if offset + length < total else None


def keyset(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Rows after a key (O3, F21): a filter and a top-k, no offset."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def numbered(df: DataFrame, order: list[Column], limit=None, offset=None, name: str = "n") -> DataFrame:
    """A page with its row numbers, which go on from the offset (W7). The window is over the page only."""
    n, at = clamp(limit, offset)
    rows = df.orderBy(*order).offset(at).limit(n)
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + at).cast("long"))


def with_total(page_: DataFrame, df: DataFrame, name: str = "total") -> DataFrame:
    """A page with the count of all rows on each row (W6): one aggregate, no window over the table."""
    return page_.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def in_list_order(df: DataFrame, ids: DataFrame, key: str, rank: str) -> DataFrame:
    """Rows by the rank their id has in a list; ids without a row drop out."""
    return df.join(ids.select(key, rank), key).orderBy(rank)


def in_fixed_order(df: DataFrame, column: str, order: tuple[str, ...], *more: Column) -> DataFrame:
    """Rows by the place of a value in a fixed list, unknown values last."""
    from quern.functions.text import ranked_in

    return df.orderBy(ranked_in(F.col(column), order), *more)


def nulls_last(columns: list[str], descending: tuple[str, ...] = ()) -> list[Column]:
    """An order whose nulls come last, whichever way a column is sorted."""
    return [F.desc_nulls_last(c) if c in descending else F.asc_nulls_last(c) for c in columns]


def site_order(by: str, blocks: str = "blocks", rank: str = "rank", brand: str = "brand") -> list[Column]:
    """Sorts of a grid of sites (O11): ``az``, ``traffic``, or what is captured most."""
    if by == "az":
        return [F.asc(brand)]
    return ([] if by == "traffic" else [F.desc(blocks)]) + nulls_last([rank, brand])
