"""Materialisation in the shared folder and bounded broadcast: what the operators need from a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs in one process (tests), one of our own."""
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.conf.get("spark.brindle.scratch", None)
        if not place:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            place = "file://" + tempfile.mkdtemp(prefix="brindle-")
            spark.conf.set("spark.brindle.scratch", place)
    return place.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that a worker's memory does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_scopes: list[list[tuple[SparkSession, str]]] = []


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Tasks are cut by the bytes of files, so a codec that makes files small makes tasks large: zstd is for texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scoped(f):
    """Deletes what f staged, once it returns, but for what its result reads; that goes with the scope around it."""

    @wraps(f)
    def run(*args, **options):
        _scopes.append([])
        used: set[str] = set()
        try:
            out = f(*args, **options)
            if isinstance(out, DataFrame):
                used = {x.rpartition("/")[0].rpartition("/")[2] for x in out.inputFiles()}
            return out
        finally:
            made = _scopes.pop()
            for spark, path in made:
                if path.rpartition("/")[2] in used:
                    if _scopes:
                        _scopes[-1].append((spark, path))
                else:
                    _delete(spark, path)

    return run


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete what `stage` wrote for df, once nothing reads it any more."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if "/brindle/" in f:
            _delete(df.sparkSession, f)
