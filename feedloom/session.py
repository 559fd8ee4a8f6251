"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Refuse to derive days of storage in a session of another time zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise RuntimeError(f"days are UTC days, but the session's zone is {zone}: call prepare()")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Every executor must reach it, so it is only ever made up here for a local
    master, where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="feedloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


# What this driver has had written under the shared folder.
_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    path = f"{shared_folder(spark)}/feedloom/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def remove_intermediates(spark: SparkSession) -> int:
    """Delete the intermediate tables of this driver; returns how many paths there were.

    For the end of a run: frames that were made before may read these tables, so their
    results must have been written.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_SCRATCH)
    while _SCRATCH:
        folder = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        folder.getFileSystem(hadoop).delete(folder, True)
    return count


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors.

    Used where a result must not be computed twice, either because computing it
    is dear (model calls) or because two evaluations might differ. ``options`` are
    the writer's.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_present(read, empty_schema, spark: SparkSession) -> DataFrame:
    """``read()``, or an empty frame when its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], empty_schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
