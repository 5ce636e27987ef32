"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_COPIES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a temporary folder is made;
    on a cluster the setting must name a shared file system.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="paperlake-")
    return _OWN[app]


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a checkpoint of rows the copy is columnar and compressed and its size is
    known to the planner; losing an executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/paperlake-{label}-{uuid.uuid4().hex}"
    _remember(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remember(spark: SparkSession, path: str) -> None:
    """Note a copy, to be deleted at the end of the run."""
    app = spark.sparkContext.applicationId
    if app not in _COPIES:
        _COPIES[app] = []
        atexit.register(release, spark)
    _COPIES[app].append(path)


def release(spark: SparkSession) -> int:
    """Delete the copies of this run from the shared folder; what reads them can't be computed again after it."""
    if spark.sparkContext._jsc is None:  # stopped: nothing can be reached any more
        return 0
    paths = _COPIES.pop(spark.sparkContext.applicationId, [])
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
