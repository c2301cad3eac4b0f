"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. In local mode, where all is one machine, one of our own if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _open_scratches:
        paths.append(path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """stored(), but outside any scratch(): the table and its path, for the caller to delete."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage is cut there, and no executor's loss costs it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open_scratches: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end; results must be written elsewhere before."""
    paths: list[str] = []
    _open_scratches.append(paths)
    try:
        yield
    finally:
        _open_scratches.remove(paths)
        for path in paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark gives one without."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def opened(path: str):
    """(file system, path in it) of a URI, for Python workers. Hadoop's s3a is Arrow's s3."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path).replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, dropped: DataFrame, name: str, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in dropped, whose size grows with docs: a shuffle join at every size."""
    return docs.join(stored(dropped.select(id_col).distinct(), name).hint("merge"), id_col, "left_anti")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, as texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator needs, a null text as the empty text; whatever else the input has is left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
