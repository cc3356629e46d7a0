"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session does not name one, a local session (tests) gets a
    temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            found = jvm.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="quern-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/quern/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: what is read back does not depend on any executor
    that took part in making it.
    """
    spark = session_of(df)
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the tables behind frames made by :func:`written` once all that was derived from them is written too."""
    for df in frames:
        if files := df.inputFiles():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names renamed, and the names to give back to them.

    For the names an operator uses itself: columns of the input that happen to
    have them come through as they are.
    """
    taken, back = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() in names:
            new = f"__aside_{c}"
            while new.lower() in taken:
                new += "_"
            back[new] = c
    return df.withColumnsRenamed({old: new for new, old in back.items()}) if back else df, back


def ascii_lower(column):
    """Lower-case A-Z only; other characters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 32 << 20) -> None:
    """Bound what an Arrow batch holds, unless the session's own bounds are smaller."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, most)
