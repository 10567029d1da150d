"""User functions over rows, with a declared schema and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Rows = dict[str, Any] | list[dict[str, Any]] | None


def map_rows(df: DataFrame, fn: Callable[[dict[str, Any]], Rows], schema: str | StructType) -> DataFrame:
    """``fn(row)`` gives one row, several or none; every row has exactly the declared fields.

    Missing values reach ``fn`` as None and integers stay exact.
    """
    declared = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, arrow = list(declared.names), to_arrow_schema(declared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made = fn(row)
                for one in [] if made is None else made if isinstance(made, list) else [made]:
                    if set(one) != set(names):
                        raise ValueError(f"row fields {sorted(one)} are not {sorted(names)}")
                    out.append(one)
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, declared)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Vectorised form: ``fn`` sees a whole Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
