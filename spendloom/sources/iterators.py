"""Tables from iterators: each part is drawn inside its own task, row by row, ragged rows padded."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spendloom.operators import shipping

BATCH = 5_000
_number = itertools.count()

#: A function without arguments that begins a part anew; a failed task calls it again.
Part = Callable[[], Iterable[object]]


def fitted(row: object, columns: list[str]) -> list[str | None]:
    """A row (a mapping by name, or a sequence) as texts, one a column: short ones padded with nulls, long ones cut."""
    cells = [row.get(c) for c in columns] if isinstance(row, dict) else [*row][: len(columns)]
    return [None if c is None else str(c) for c in cells] + [None] * (len(columns) - len(cells))


class _At(InputPartition):
    def __init__(self, at: int):
        self.at = at


def ragged(spark: SparkSession, columns: list[str], parts: list[Part]) -> DataFrame:
    """A table of text columns whose rows the parts yield; each part is a task and never held whole.

    Rows are mappings or sequences. A part that fails is begun anew by the task's next attempt, and
    a table written from this has its rows once: only a finished attempt's files are committed.
    """
    if not columns or len({*columns}) < len(columns):
        raise ValueError("columns must be named, each once")
    shipping.ship(spark)
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [_At(i) for i in range(len(parts))] or [_At(-1)]

        def read(self, partition: _At) -> Iterator[pa.RecordBatch]:
            held: list[list[str | None]] = []
            rows = iter(parts[partition.at]()) if partition.at >= 0 else iter(())
            while held := [fitted(r, columns) for r in itertools.islice(rows, BATCH)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], columns)

    name = f"ragged_{next(_number)}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def store(session, name: str, columns: list[str], parts: list[Part]) -> int:
    """Write the parts' rows as a session's table; how many rows there are."""
    return session.save(name, ragged(session.spark, columns, parts)).count()
