"""Reading inputs and staging intermediate tables in the folder all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendloom.operators import shipping

BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20

#: Staged paths and tables by the scope they were made in.
_staged: dict[str, list[str]] = defaultdict(list)
_tables: dict[str, list[str]] = defaultdict(list)
_scope = [""]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and bound the batches that go to Python workers.

    They are bound by rows and by bytes, for texts of any length. The settings stay with the
    session, since a plan reads them when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    shipping.ship(spark)


def row_keys(id_column: str, text_column: str) -> dict[str, Column]:
    """Columns k1, k2: 128 bits of a row's id and text, equal for repeated rows and never null."""
    return {"k1": F.xxhash64(id_column, text_column), "k2": F.xxhash64(text_column, F.lit(1), id_column)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _write(df: DataFrame, name: str) -> str:
    path = f"{shipping.shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def stage(df: DataFrame, name: str) -> DataFrame:
    """As written(), for tables that nothing reads once an operator's result is written."""
    spark = df.sparkSession
    path = _write(df, name)
    _staged[_scope[-1]].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is computed inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str, *columns: str, dealt: bool = False) -> DataFrame:
    """As stage(), dealt into buckets of columns: joins on them move the other side only.

    dealt: df comes from a table in such buckets, and its rows need not move.
    """
    spark = df.sparkSession
    buckets, mark = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    path, table = f"{shipping.shared_dir(spark)}/{name}-{mark}", f"staged_{mark}"
    (df if dealt else df.repartition(buckets, *columns)).write.bucketBy(buckets, *columns).option("path", path).option("compression", "zstd").saveAsTable(table)
    _staged[_scope[-1]].append(path)
    _tables[_scope[-1]].append(table)
    return spark.table(table)


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """What is staged inside belongs to a run of that name, and release() of another leaves it alone."""
    _scope.append(name)
    try:
        yield
    finally:
        _scope.pop()


def release(spark: SparkSession, name: str = "") -> None:
    """Delete what was staged in a scope. Only for callers whose results no longer read it."""
    for table in _tables.pop(name, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for staged in _staged.pop(name, []):
        path = jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(conf).delete(path, True)
