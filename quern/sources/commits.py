"""Stored tables that change as a whole: immutable version folders and one small pointer written last.

A table is a folder. Each version lies in a folder of its own below it and is
never touched again; ``_commits`` holds a numbered pointer per version. Writing
the pointer is the commit. A reader takes the highest pointer it can read in
full, so it sees the rows of one version, old or new, at every moment, and no
rename of a folder is needed, which object stores do not have.

Pointers are created exclusively: of two writers that start from one version
the second gets :class:`Conflict`. A pointer that a lost writer left half written
is passed over.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the next version first."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    properties: dict = field(default_factory=dict)


def workspace(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a folder in the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quern"


def path_of(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers there are, the newest first."""
    at, fs = path_of(spark, f"{root}/_commits")
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def version(spark: SparkSession, root: str, number: int) -> Version | None:
    """The version of a pointer; None if it is not whole."""
    at, fs = path_of(spark, f"{root}/_commits/{number:020d}.json")
    try:
        stream = fs.open(at)
        try:
            told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    except Exception as e:  # noqa: BLE001 - half written, or removed by prune meanwhile
        if isinstance(e, ValueError) or "FileNotFound" in str(e):
            return None
        raise
    return Version(number, told["folder"], told["properties"])


def current(spark: SparkSession, root: str) -> Version | None:
    """The newest whole version; None if there is none."""
    return next((v for n in numbers(spark, root) if (v := version(spark, root, n))), None)


def point(spark: SparkSession, root: str, folder: str, properties: dict | None = None, after: Version | None = None) -> Version:
    """Commit: the pointer to ``folder`` follows ``after`` (the newest version, if not given)."""
    base = after or current(spark, root)
    seen = max(numbers(spark, root), default=-1)
    if base and seen > base.number and version(spark, root, seen):
        raise Conflict(f"{root} has gone on to version {seen}")
    number = max(seen, base.number if base else -1) + 1
    at, fs = path_of(spark, f"{root}/_commits/{number:020d}.json")
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            raise Conflict(f"{root} has a version {number} already") from e
        raise
    stream.write(bytearray(json.dumps({"folder": folder, "properties": properties or {}}).encode()))
    stream.close()
    return Version(number, folder, properties or {})


def fresh(root: str) -> str:
    return f"{root}/v-{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, write: Callable[[str], None], properties: dict | None = None, keep: int = 2) -> Version:
    """A new version: ``write(folder)`` fills it, the pointer makes it the current one, versions beyond ``keep`` go."""
    before, folder = current(spark, root), fresh(root)
    write(folder)
    made = point(spark, root, folder, properties, before)
    prune(spark, root, keep)
    return made


def read(spark: SparkSession, root: str, part: str = "") -> DataFrame:
    """The rows of the current version, or of one of its parts."""
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"{root} has no version")
    return spark.read.parquet(f"{found.folder}/{part}".rstrip("/"))


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions; readers of a version that old have to read again."""
    whole = [v for n in numbers(spark, root) if (v := version(spark, root, n))]
    for v in whole[keep:]:
        pointer, fs = path_of(spark, f"{root}/_commits/{v.number:020d}.json")
        fs.delete(pointer, False)
        if v.folder not in {x.folder for x in whole[:keep]}:
            remove(spark, v.folder)


def remove(spark: SparkSession, folder: str) -> None:
    at, fs = path_of(spark, folder)
    fs.delete(at, True)


def signature(spark: SparkSession, path: str) -> str:
    """Files of a stored table with their sizes and times: another one after any change."""
    at, fs = path_of(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        s = files.next()
        found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
