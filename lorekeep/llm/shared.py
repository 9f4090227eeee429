"""What the training-data operators share: scratch tables, row handles and small column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); on one machine a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lorekeep-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lorekeep-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    return stored_parts([df], name, compression)


def stored_parts(parts: Iterable[DataFrame], name: str, compression: str = "zstd") -> DataFrame:
    """The same for a table that comes in parts of one schema (one at least), written one after another."""
    path, folders, schema = "", [], None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        folders.append(f"{path}/{len(folders)}")
        options = {"compression": compression, "parquet.compression.codec.zstd.level": "1"}
        df.write.options(**options).parquet(folders[-1])
    table = spark.read.schema(schema).parquet(*folders)
    table.stored_at = path
    return table


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables stored in this block hand so many rows at once to Python: whole texts of many rows would fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now, not when the driver next needs memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_broadcast(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint only when the counted ``rows`` are within ``limit``; beyond it the join shuffles."""
    return F.broadcast(small) if rows <= limit else small


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
