"""Tables kept for a session in a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where all is one machine, a folder of our own if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def kept(spark: SparkSession, key: tuple, make) -> DataFrame:
    """The table make() gives, written at its first use in this application and read from there afterwards."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _kept:
        df = make()
        path = f"{folder(spark)}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _kept[full] = path
    return spark.read.parquet(_kept[full])


def written(df: DataFrame, name: str, parts: list[str] | None = None, **options) -> DataFrame:
    """The table, written to the shared folder now and read from there."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).partitionBy(*parts or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_file(path: str) -> tuple[fs.FileSystem, str]:
    """A file of the shared folder for Arrow, in a Python worker. Hadoop's s3a is Arrow's s3."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path).replace("s3a://", "s3://", 1))
