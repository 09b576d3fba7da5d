"""Lineage cuts in the shared folder the cluster names.

Long plans (a cascade over a cascade, a loop over pages) are cut in two ways, both of which survive the loss of any
executor: tables that several operators read column by column are written as bucketed Parquet, slim
states that are read once as reliable checkpoints.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; local sessions without one get a folder of their own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(named)
    return named


def spread(frame: DataFrame, *keys: str | Column) -> DataFrame:
    """Deal rows to every core by ``keys`` (in turn, if there are none), whatever files they come in.

    A table of millions of narrow rows is often one row group, which no reader can split: without this all that is made of
    it, pages above all, would be made by one task.
    """
    spark = frame.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return frame.repartition(n, *keys)


#: Buckets a task writes side by side before it sorts its rows by bucket.
OPEN_BUCKETS = 8
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

#: Bytes of pages whose tables make a bucket.
BUCKET_BYTES = 32 << 20

#: What holds while a table is written. Sides of a join that lie by one of its keys, the page, are merged where they are, not
#: moved by all keys. Generated methods that the JVM would only ever interpret, being longer than it compiles, are made
#: of smaller ones: most steps here have long expressions.
WRITING = {_WRITERS: OPEN_BUCKETS, "spark.sql.requireAllClusterKeysForCoPartition": False, "spark.sql.codegen.hugeMethodLimit": 8000}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in WRITING}
    for name, value in WRITING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def buckets_for(spark: SparkSession, size: int) -> int:
    """Buckets for tables derived from ``size`` bytes of pages: by their size, and no fewer than the session's partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def bucketed(frame: DataFrame, *keys: str, placed: bool = False, buckets: int | None = None) -> DataFrame:
    """``frame`` as a Parquet table in the shared folder, bucketed by ``keys``, and read back.

    Readers take only the columns they name, and know which rows lie together: windows, aggregates and joins on the keys
    need no further shuffle. ``placed`` says that the rows already lie by the keys and are written where they are. A task
    has the rows of one bucket, or of a few, and writes them as they come: sorting them by bucket first would move every
    element row for nothing. The table's name is forgotten at once (the catalog keeps nothing); its files are the folder's to clean.

    Joins with the table are merges. Spark would judge it by its compressed files, a few bytes a row and a fraction of that
    where few columns are read, and pass tens of millions of element rows through the driver as a small table.
    What is written may rest on joins by page and element: sides that lie by page are merged there, not moved by both keys.
    """
    spark = frame.sparkSession
    n = buckets or buckets_for(spark, 0)
    name = f"staged_{uuid.uuid4().hex}"
    rows = frame if placed else frame.repartition(n, *keys)
    with _writing(spark):
        rows.write.format("parquet").option("path", f"{checkpoint_folder(spark)}/{name}").bucketBy(n, *keys).saveAsTable(name)
    try:
        return spark.table(name).hint("merge")
    finally:
        spark.sql(f"drop table {name}")


def cut(frame: DataFrame, *keys: str) -> DataFrame:
    """Write ``frame`` to the checkpoint folder, hash-partitioned by ``keys`` if there are any, and go on from there."""
    checkpoint_folder(frame.sparkSession)
    if keys:
        frame = frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    with _writing(frame.sparkSession):
        return _renamed(frame.checkpoint(eager=True))


def _renamed(frame: DataFrame) -> DataFrame:
    """Columns of their own: a checkpoint carries its source's attribute ids, which clash in a join with that source."""
    return frame.select(*[F.col(f"`{c}`").alias(c) for c in frame.columns])
