"""A stored table of the newest row of each key, kept up by small writes (U4, U7, T-13).

Rows lie in buckets by the hash of their key. A batch writes its newest rows to
the buckets it touches and nothing else; readers take the newest of what a
bucket's folders hold. A bucket with more than ``DELTAS`` folders is compacted
into one, in the same commit. The pointer of each version (:mod:`commits`) lists
the folders of every bucket, so a version never changes under a reader, and the
number of the batch, so a batch that runs again changes nothing. Versions beyond
``keep`` go, with the folders that no version left names.

Ties in time go to the later batch, within a batch to the larger row by its
other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.versions import first_per_key
from quern.sources import commits

BUCKETS, DELTAS, KEEP = 64, 4, 3
_BATCH = "__batch"


def _newest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, at, _BATCH)]
    return first_per_key(rows, keys, [F.desc_nulls_last(at), F.desc(_BATCH), *[F.desc(c) for c in rest]])


def _write(rows: DataFrame, folder: str, keys: list[str], buckets: int) -> list[str]:
    """Rows by bucket; the buckets that got any."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    at, fs = commits.path_of(rows.sparkSession, folder)
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(n.split("=")[1] for n in names if n.startswith("__bucket="))


def _rows(spark: SparkSession, version: commits.Version, buckets: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(version.properties["schema"])
    files = version.properties["files"]
    paths = [f"{folder}/__bucket={b}" for b in (buckets if buckets is not None else files) for folder in files[b]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(root: str, batch: DataFrame, keys: list[str], at: str, number: int | None = None, buckets: int = BUCKETS, deltas: int = DELTAS, keep: int = KEEP) -> commits.Version:
    """Take the newest row of each key of ``batch`` into the table; a batch whose ``number`` is not above the last one is done already."""
    spark = batch.sparkSession
    before = commits.current(spark, root)
    told = before.properties if before else {"buckets": buckets, "keys": keys, "at": at, "batch": -1, "files": {}}
    if (told["keys"], told["at"]) != (keys, at):
        raise ValueError(f"the table's keys are {told['keys']} at {told['at']}")
    number = number if number is not None else told["batch"] + 1
    if before and number <= told["batch"]:
        return before
    rows = batch.withColumn(_BATCH, F.lit(number).cast("long"))
    delta = commits.fresh(root)
    touched = _write(_newest(rows, keys, at), delta, keys, told["buckets"])
    files = {b: list(folders) for b, folders in told["files"].items()}
    for b in touched:
        files.setdefault(b, []).append(delta)
    made = {**told, "batch": number, "files": files, "schema": rows.schema.jsonValue()}
    full = [b for b in touched if len(files[b]) > deltas]
    if full:
        whole, base = _rows(spark, commits.Version(-1, root, made), full), commits.fresh(root)
        for b in _write(_newest(whole, keys, at), base, keys, told["buckets"]):
            files[b] = [base]
    version = commits.point(spark, root, root, made, before)
    _prune(spark, root, keep)
    return version


def read(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each key, as of the current version."""
    found = commits.current(spark, root)
    if found is None:
        raise FileNotFoundError(f"{root} has no version")
    return _newest(_rows(spark, found), found.properties["keys"], found.properties["at"]).drop(_BATCH)


def _prune(spark: SparkSession, root: str, keep: int) -> None:
    versions = [v for n in commits.numbers(spark, root) if (v := commits.version(spark, root, n))]
    named = lambda vs: {(b, f) for v in vs for b, folders in v.properties["files"].items() for f in folders}
    for b, folder in named(versions[keep:]) - named(versions[:keep]):
        commits.remove(spark, f"{folder}/__bucket={b}")
    for folder in {f for _, f in named(versions[keep:])} - {f for _, f in named(versions[:keep])}:
        commits.remove(spark, folder)
    for v in versions[keep:]:
        commits.remove(spark, f"{root}/_commits/{v.number:020d}.json")
