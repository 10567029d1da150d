"""Databases through any Python DB-API module, as a Spark data source: range partitions in batch, the position as offset in streams.

No jar is needed, only the module on the executors. Each task opens a connection of its own and fetches a bounded number of
rows at a time into Arrow batches. Values are bound as parameters; table and column names come from the caller.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FETCH = 10_000  # rows that a task asks for at once
#: How a module marks the n-th parameter, by its paramstyle.
MARKS = {"qmark": "?", "format": "%s", "pyformat": "%s", "numeric": ":{n}"}


PLACE = "\0"  # stands for a parameter until the module's mark is known


class Range(InputPartition):
    """Rows whose column is above ``low`` (or from it on) and below ``high`` (or up to it); None: no bound. ``missing``: also rows without a value."""

    def __init__(self, low: Any = None, high: Any = None, closed: str = "low", missing: bool = False):
        super().__init__(None)
        self.low, self.high, self.closed, self.missing = low, high, closed, missing


def cut_points(low: Any, high: Any, parts: int) -> list[Any]:
    """Values that cut numbers from ``low`` to ``high`` into at most ``parts`` even ranges; none for other types."""
    if parts < 2 or isinstance(low, (str, bytes, bool)) or not isinstance(low, (int, float)) or not low < high:
        return []
    step = (high - low) / parts
    exact = isinstance(low, int) and isinstance(high, int)
    found = [low + ((high - low) * k // parts if exact else step * k) for k in range(1, parts)]
    return sorted(set(found) - {low})


class _Database:
    """What reading in batch and in streams share. Options are text, as Spark hands them on."""

    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.names, self.json = [f.name for f in schema.fields], schema.json()
        self.module, self.table, self.column = options["module"], options["table"], options.get("column")
        self.connect = json.loads(options.get("connect", "[]"))
        self.parts, self.fetch = int(options.get("partitions", "1")), int(options.get("fetch", FETCH))

    def rows(self, sql: str, values: Sequence[Any] = ()) -> Iterator[list[tuple]]:
        module = import_module(self.module)
        mark = MARKS[module.paramstyle]
        args = self.connect if isinstance(self.connect, list) else []
        named = self.connect if isinstance(self.connect, dict) else {}
        connection = module.connect(*args, **named)
        try:
            cursor = connection.cursor()
            first, *rest = sql.split(PLACE)
            cursor.execute(first + "".join(mark.format(n=n) + text for n, text in enumerate(rest, 1)), tuple(values))
            while found := cursor.fetchmany(self.fetch):
                yield found
        finally:
            connection.close()

    def bounds(self) -> tuple[Any, Any]:
        found = next(self.rows(f"SELECT min({self.column}), max({self.column}) FROM {self.table}"))
        return found[0][0], found[0][1]

    def ranges(self, low: Any, high: Any) -> list[Range]:
        """Half-open ranges over all values, rows without one in the first."""
        cuts = cut_points(low, high, self.parts)
        edges = [None, *cuts, None]
        return [Range(a, b, missing=k == 0) for k, (a, b) in enumerate(zip(edges, edges[1:]))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        tests, values = [], []
        for value, test in ((partition.low, ">=" if partition.closed == "low" else ">"), (partition.high, "<" if partition.closed == "low" else "<=")):
            if value is not None:
                tests.append(f"{self.column} {test} {PLACE}")
                values.append(value)
        where = " AND ".join(tests)
        if where and partition.missing:
            where = f"({where}) OR {self.column} IS NULL"
        sql = f"SELECT {', '.join(self.names)} FROM {self.table}" + (f" WHERE {where}" if where else "")
        fields = arrow_schema(self.json)
        for found in self.rows(sql, values):
            columns = [pa.array([_value(r[k], f.type) for r in found], f.type) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)


def arrow_schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromJson(json.loads(text)))


def _value(value: Any, kind: pa.DataType) -> Any:
    """Databases without such types hand dates and times on as ISO text, truth as numbers and decimals as floats."""
    if value is None:
        return None
    if pa.types.is_boolean(kind):
        return bool(value)
    if pa.types.is_decimal(kind):
        return value if isinstance(value, Decimal) else Decimal(str(value))
    if pa.types.is_date(kind) and isinstance(value, str):
        return date.fromisoformat(value)
    if pa.types.is_timestamp(kind) and isinstance(value, str):
        return datetime.fromisoformat(value)
    if pa.types.is_string(kind) and not isinstance(value, str):
        return str(value)
    return value


class _Reader(_Database, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [Range()] if self.column is None else self.ranges(*self.bounds())


class _Stream(_Database, DataSourceStreamReader):
    """Rows by growing position: a batch has those above the last position handled, up to the greatest at its start."""

    def initialOffset(self) -> dict:
        return {"position": None}

    def latestOffset(self) -> dict:
        return {"position": self.bounds()[1]}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = start["position"], end["position"]
        if high is None or low == high:
            return []
        cuts = cut_points(low if low is not None else self.bounds()[0], high, self.parts)
        edges = [low, *cuts, high]
        return [Range(a, b, closed="high") for a, b in zip(edges, edges[1:])]

    def commit(self, end: dict) -> None:
        pass


class DatabaseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomframe_dbapi"

    def schema(self) -> StructType:
        raise ValueError("name the columns to read and their types with .schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)


def _options(module: str, connect: Sequence | Mapping, table: str, column: str | None, partitions: int) -> dict[str, str]:
    made = {"module": module, "connect": json.dumps(connect), "table": table, "partitions": str(partitions)}
    return made | ({"column": column} if column else {})


def read_database(
    spark: SparkSession, module: str, connect: Sequence | Mapping, table: str, schema: str, column: str | None = None, partitions: int = 1
) -> DataFrame:
    """A table, or a query in brackets with a name, read in ``partitions`` even ranges of a numeric ``column``.

    Only the columns of ``schema`` are asked for. Ranges reach to both sides without bound, and rows without a value
    belong to the first, so each row is read once, also if it came after the bounds were looked up.
    """
    spark.dataSource.register(DatabaseSource)
    return spark.read.format(DatabaseSource.name()).schema(schema).options(**_options(module, connect, table, column, partitions)).load()


def stream_database(
    spark: SparkSession, module: str, connect: Sequence | Mapping, table: str, schema: str, column: str, partitions: int = 1
) -> DataFrame:
    """New rows of a table as a stream; ``column`` must grow with every new row. The checkpoint keeps the position."""
    spark.dataSource.register(DatabaseSource)
    return spark.readStream.format(DatabaseSource.name()).schema(schema).options(**_options(module, connect, table, column, partitions)).load()
