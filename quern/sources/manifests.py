"""Capture manifests: one nested JSON document per page, and the tables they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.functions.text import clean, js_round
from quern.operators.joins import small
from quern.operators.versions import first_per_key
from quern.sources import commits


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents below a folder, and those that are no such document (S1, S2, U10). ``folder`` is where each lies."""
    schema = schemas.struct(schemas.MANIFEST + ", _corrupt_record string")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(path)
    raw = raw.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", ""))
    bad = F.col("site.host").isNull() | F.col("page.url").isNull()
    return raw.where(~bad).drop("_corrupt_record"), raw.where(bad).select("folder", "_corrupt_record")


def parse_manifests(df: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Documents in a text column, and the rows whose text is no such document; other columns are kept."""
    schema = schemas.struct(schemas.MANIFEST + ", _corrupt_record string")
    rows = df.withColumn("__d", F.from_json(document, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("__d._corrupt_record").isNotNull() | F.col("__d.site.host").isNull() | F.col("__d.page.url").isNull()
    return rows.where(~bad).select(*[c for c in df.columns if c != document], *[f"__d.{c}" for c in ("site", "page", "viewports", "blocks")]), rows.where(F.coalesce(bad, F.lit(True))).drop("__d")


def import_manifests(good: DataFrame, bad: DataFrame, root: str) -> commits.Version:
    """All tables of an import and what it could not read, as one version: ``sites``, ``pages``, ``captures``, ``blocks``, ``quarantine``.

    Readers see the tables of one import together; a bad document keeps none of
    the others out, and waits in quarantine.
    """
    tables = {"sites": site_rows, "pages": page_rows, "captures": capture_rows, "blocks": block_rows}

    def write(folder: str) -> None:
        for name, rows in tables.items():
            rows(good).write.parquet(f"{folder}/{name}")
        bad.write.parquet(f"{folder}/quarantine")

    return commits.commit(good.sparkSession, root, write)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Image facts beside the manifests (S3); folders without them simply have no row."""
    rows = spark.read.schema(schemas.SIDECAR).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "images.json").json(path)
    return rows.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")).select("folder", "images")


def theme_name(theme: Column) -> Column:
    """``name``, else ``schema_name``, if it is a text."""
    value = F.try_parse_json(theme)
    text = lambda p: F.nullif(F.try_variant_get(value, p, "string"), F.lit(""))
    return F.coalesce(text("$.name"), text("$.schema_name"))


def site_rows(manifests: DataFrame) -> DataFrame:
    """Sites by upsert: apps are a union, the title is that of the home page, the brand is set once."""
    rows = manifests.select("site.*", F.col("page.capturedAt").alias("at"), F.col("page.type").alias("page_type"), clean(F.col("page.title")).alias("title"))
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.groupBy("host").agg(
        *[known(c) for c in ("origin", "platform", "builder", "currency", "locale")],
        F.max_by(theme_name(F.col("theme")), F.when(F.col("theme").isNotNull(), F.col("at"))).alias("theme"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("apps")))).alias("apps"),
        F.coalesce(F.max_by("title", F.when(F.col("page_type") == "home", F.col("at"))), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("at")))).alias("title"),
    )


def page_id(host: Column, url: Column) -> Column:
    return F.sha1(F.concat_ws("\u0001", host, url))


def page_rows(manifests: DataFrame) -> DataFrame:
    """Pages, the last capture's facts (U4)."""
    rows = manifests.select(F.col("site.host").alias("host"), "page.*")
    last = first_per_key(rows, ["host", "url"], [F.desc("capturedAt")])
    return last.select(page_id(F.col("host"), F.col("url")).alias("page_id"), "host", "url", F.col("type").alias("page_type"), "slug", clean(F.col("title")).alias("title"), clean(F.col("description")).alias("description"), "canonical", F.col("ogImage").alias("og_image"), "lang", clean(F.col("h1")).alias("h1"))


def capture_rows(manifests: DataFrame) -> DataFrame:
    """Captures: one per page and time, however often the document is read."""
    pid = page_id(F.col("site.host"), F.col("page.url"))
    at = F.col("page.capturedAt")
    return manifests.select(F.sha1(F.concat_ws("\u0001", pid, at)).alias("capture_id"), pid.alias("page_id"), F.to_timestamp(at).alias("captured_at"), "viewports", "folder").dropDuplicates(["capture_id"])


def block_rows(manifests: DataFrame) -> DataFrame:
    """Blocks: rounded geometry, empty headlines as null, no NUL characters.

    They are dealt out once, by their capture, which their id tells.
    """
    pid = page_id(F.col("site.host"), F.col("page.url"))
    rows = manifests.select(F.sha1(F.concat_ws("\u0001", pid, F.col("page.capturedAt"))).alias("capture_id"), F.explode("blocks").alias("b"))
    b = lambda c: F.col(f"b.{c}")
    out = rows.select(
        "capture_id",
        b("viewport").alias("viewport"),
        b("index").alias("block_index"),
        b("typeHint").alias("type_hint"),
        *[js_round(b(c)).cast("int").alias(c) for c in ("top", "height", "width")],
        clean(b("text")).alias("text"),
        F.nullif(clean(b("headline")), F.lit("")).alias("headline"),
        b("buttons").alias("buttons"),
        b("images").alias("images"),
        b("videos").alias("videos"),
        b("bg").alias("background"),
        b("file").alias("file"),
    ).repartition("capture_id")
    block_id = F.sha1(F.concat_ws("\u0001", "capture_id", "viewport", F.col("block_index").cast("string")))
    return out.select(block_id.alias("id"), "*").dropDuplicates(["capture_id", "id"])


def with_images(blocks: DataFrame, sidecars: DataFrame, folder: str, file: str) -> DataFrame:
    """Blocks with the image facts of their file, if there are any."""
    facts = sidecars.select(F.col("folder").alias(folder), F.explode("images").alias(file, "image"))
    return blocks.join(facts, [folder, file], "left")


def image_keys(file: Column, prefix: str) -> Column:
    """Keys of an image's derived files."""
    stem = F.regexp_replace(file, r"\.[^./]+$", "")
    at = lambda tail: F.concat(F.lit(prefix.rstrip("/") + "/"), stem, F.lit(tail))
    return F.struct(at(".webp").alias("webp"), at(".thumb.webp").alias("thumbnail"))


def slice_key(file: Column, index: Column) -> Column:
    return F.concat(F.regexp_replace(file, r"\.[^./]+$", ""), F.lit(".slice-"), F.lpad(index.cast("string"), 3, "0"), F.lit(".webp"))


def edge_cases(manifests: DataFrame) -> DataFrame:
    """What is odd about each document."""
    host = F.regexp_replace(F.lower(F.try_parse_url(F.col("page.url"), F.lit("HOST"))), r"^www\.", "")
    return manifests.select(
        F.col("site.host").alias("host"),
        F.col("page.url").alias("url"),
        (F.col("viewports.desktop.error").isNotNull() | F.col("viewports.mobile.error").isNotNull()).alias("viewport_failed"),
        F.exists("blocks", lambda b: b["file"].isNull()).alias("block_without_image"),
        (host != F.col("site.host")).alias("redirected_host"),
        F.coalesce(F.try_parse_url(F.col("page.url"), F.lit("PATH")), F.lit("")).rlike(r"^/[a-z]{2}(-[a-z]{2})?(/|$)").alias("region_in_path"),
        (F.size("blocks") == 0).alias("no_blocks"),
        F.col("site.platform").isNull().alias("platform_unknown"),
        theme_name(F.col("site.theme")).isNull().alias("no_theme_info"),
    )


def index_document(manifests: DataFrame) -> DataFrame:
    """One JSON text per host with its pages (S14); hosts are rows, so no task holds them all."""
    page = F.struct(F.col("page.url").alias("url"), F.col("page.type").alias("type"), F.col("page.capturedAt").alias("capturedAt"), F.size("blocks").alias("blocks"), F.col("folder"))
    return manifests.groupBy(F.col("site.host").alias("host")).agg(F.array_sort(F.collect_list(page)).alias("pages")).select("host", F.to_json(F.struct("host", "pages")).alias("document"))


def sample_items(manifests: DataFrame, most: int = 400) -> DataFrame:
    """Blocks that have an image, texts cut to ``most`` characters."""
    rows = manifests.select("folder", F.col("site.host").alias("host"), F.col("page.type").alias("page_type"), F.explode("blocks").alias("b")).where(F.col("b.file").isNotNull())
    directory = F.regexp_extract("folder", r"([^/]+/[^/]+)$", 1)
    return rows.select(F.concat_ws("/", directory, "b.viewport", F.col("b.index").cast("string")).alias("id"), "host", "page_type", F.col("b.typeHint").alias("type_hint"), F.substring(clean(F.col("b.text")), 1, most).alias("text"), F.col("b.file").alias("file"))


def api_items(blocks: DataFrame, captures: DataFrame, pages: DataFrame, sites: DataFrame, most: int = 400) -> DataFrame:
    """The one block projection of the API (P1, J1): blocks meet what is known of their capture in one join."""
    known = captures.select("capture_id", "page_id", "captured_at").join(pages.select("page_id", "host", "page_type", "url", F.col("title").alias("page_title")), "page_id").join(small(sites.select("host", "platform", "theme", "apps")), "host")
    rows = blocks.join(known, "capture_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("id", "host", "page_type", "url", "page_title", "viewport", "type_hint", "headline", "background", "width", "height", F.col("file").alias("src"), "platform", "theme", F.coalesce("apps", F.array().cast("array<string>")).alias("apps"), zero("buttons"), zero("images"), zero("videos"), F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text"), "captured_at", "block_index")
