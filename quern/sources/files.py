"""CSV, text and JSON-lines files, and snapshot links."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions.text import base64url, host_line, suffixes, unbase64url


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV with header, all strings; missing cells are empty, rows without any content go."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).na.fill("")
    return rows.where(F.concat(*columns) != "")


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes only where a cell needs them."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def typed_seeds(seeds: DataFrame) -> DataFrame:
    """Seed rows with their types: lists by ``|``, numbers where they parse."""
    listed = lambda c: F.filter(F.split(c, r"\|"), lambda x: F.trim(x) != "").alias(c)
    number = {"tranco_rank": "int", "mentions": "int", "collections": "int", "strong_signals": "int", "store_signals": "int", "industry_score": "double"}
    return seeds.select(*[listed(c) if c in ("apps", "sources") else F.col(c).try_cast(number[c]).alias(c) if c in number else F.nullif(c, F.lit("")).alias(c) for c in seeds.columns])


def stores_export(seeds: DataFrame) -> DataFrame:
    """Stores in rank order with their number, host and display host."""
    from quern.operators import prefix

    final = F.coalesce(F.col("final_host"), F.col("host"))
    shown = F.when(final.endswith(".myshopify.com"), F.col("host")).otherwise(final)
    order = [F.asc_nulls_last("tranco_rank"), F.asc("host")]
    return prefix.numbered(typed_seeds(seeds).withColumn("display_host", shown), order)


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """Hosts of a text file, one a line; comments and blank lines go."""
    return spark.read.text(path).select(host_line(F.col("value")).alias("host")).where(F.col("host").isNotNull())


def read_host_reasons(spark: SparkSession, path: str) -> DataFrame:
    """``host reason...`` lines."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return rows.select(F.lower(F.regexp_extract(line, r"^(\S+)\s*(.*)$", 1)).alias("host"), F.nullif(F.regexp_extract(line, r"^(\S+)\s*(.*)$", 2), F.lit("")).alias("reason"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``rank,host`` lines of CSV files or of the CSV members of ZIP files.

    A ZIP is read by the task that gets it, wherever Spark can read, and never
    unpacked anywhere: its lines leave as they are inflated.
    """
    if not path.endswith(".zip"):
        return spark.read.schema("rank int, host string").csv(path)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".csv")):
                        with z.open(name) as member:
                            while some := list(itertools.islice(member, 10_000)):
                                yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace").rstrip("\r\n") for x in some])], ["line"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "line string")
    return raw.select(F.from_csv("line", "rank int, host string").alias("r")).select("r.*")


def feed_items(pages: DataFrame, feed: str, number: str, items: str, full: int) -> DataFrame:
    """(feed, number, place, item) of landed pages of feeds, numbered from 1: up to the first page that is short or missing."""
    page = Window.partitionBy(feed).orderBy(number)
    # a page counts while all before it are there and full
    seen = pages.withColumn("__n", F.row_number().over(page)).withColumn("__short", F.coalesce(F.max((F.size(items) < full).cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return seen.where((F.col("__n") == F.col(number)) & (F.col("__short") == 0)).select(feed, number, F.posexplode(items).alias("place", "item"))


def sitemap_urls(xml: DataFrame, column: str, pattern: str) -> DataFrame:
    """Distinct ``<loc>`` addresses that fit a pattern."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return xml.select(F.explode(found).alias("url")).where(F.col("url").rlike(pattern)).distinct()


def outbound_links(pages: DataFrame, page_id: str, html: str, own: Column | None = None) -> DataFrame:
    """(page, host) of links that lead elsewhere, each host once a page."""
    from quern.functions.text import host_of

    urls = F.regexp_extract_all(F.col(html), F.lit(r'href="(http[^"]+)"'), F.lit(1))
    rows = pages.select(page_id, (own if own is not None else F.lit(None).cast("string")).alias("own"), F.explode(urls).alias("url")).withColumn("host", host_of(F.col("url")))
    return rows.where(F.col("host").isNotNull() & ~F.col("host").eqNullSafe(F.col("own"))).select(page_id, "host").distinct()


def page_links(pages: DataFrame, page_id: str, html: str, origin: Column, most: int) -> DataFrame:
    """Links within a site in document order, variants of one address once, the first ``most``."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"#]+)'), F.lit(1))
    rows = pages.select(page_id, origin.alias("origin"), F.posexplode(found).alias("seq", "href"))
    url = F.when(F.col("href").startswith("/"), F.concat("origin", "href")).otherwise(F.col("href"))
    rows = rows.withColumn("url", url).where(F.col("url").startswith(F.col("origin"))).withColumn("key", F.lower(F.regexp_replace("url", r"[?/]+$", "")))
    firsts = rows.groupBy(page_id, "key").agg(F.min("seq").alias("seq"), F.min_by("url", "seq").alias("url"))
    place = F.row_number().over(Window.partitionBy(page_id).orderBy("seq"))
    return firsts.withColumn("place", place).where(F.col("place") <= most).select(page_id, "place", "url")


def append_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from values."""
    return spark.createDataFrame(rows, schema)


def zipped(spark: SparkSession, **lists: list) -> DataFrame:
    """Lists side by side as a table, with their ordinal."""
    one = spark.range(1).select(F.posexplode(F.arrays_zip(*[F.array(*map(F.lit, v)).alias(k) for k, v in lists.items()])).alias("ordinal", "z"))
    return one.select("ordinal", *[F.col("z")[k].alias(k) for k in lists])


def snapshot_link(board: Column) -> Column:
    """A board as text for an address: JSON in base64url."""
    return base64url(F.encode(F.to_json(board), "UTF-8"))


def read_snapshot_link(code: Column, schema: str) -> Column:
    return F.from_json(F.decode(unbase64url(code), "UTF-8"), schema)


def image_prefixes(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """Distinct keys that match in any of several text columns."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(pattern), F.lit(0)) for c in columns]))
    return df.select(F.explode(found).alias("key")).distinct()


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Objects with their path, length and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def parent_domains(df: DataFrame, host: str) -> DataFrame:
    return df.select(host, F.explode(suffixes(F.col(host))).alias("domain"))
