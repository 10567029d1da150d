"""Readers, incremental extracts and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators.transforms import BOM, beyond, free_name

# Media types by file extension.
MEDIA_TYPES = {
    "parquet": "application/vnd.apache.parquet",
    "csv": "text/csv",
    "json": "application/json",
    "txt": "text/plain",
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "mp4": "video/mp4",
}

MAX_PAGE_ROWS = 10_000


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(list(paths))


def clean_header(df: DataFrame) -> DataFrame:
    """Strip byte-order marks from column names and number the ones that then collide."""
    names: list[str] = []
    for c in df.columns:
        names.append(free_name(c.lstrip(BOM), set(names)))
    return df.toDF(*names)


def read_csv(spark: SparkSession, *paths: str, schema: str | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header)
    return clean_header((reader.schema(schema) if schema else reader).csv(list(paths)))


def read_json(
    spark: SparkSession, *paths: str, schema: str | None = None, rows: str | None = None, multi_line: bool = False
) -> DataFrame:
    """JSON lines, or documents whose ``rows`` field holds the rows."""
    reader = spark.read.option("multiLine", multi_line)
    df = (reader.schema(schema) if schema else reader).json(list(paths))
    return df.select(F.explode(rows).alias("_row")).select("_row.*") if rows else df


def read_avro(spark: SparkSession, *paths: str) -> DataFrame:
    """Needs the external spark-avro package on the classpath."""
    return _external(lambda: spark.read.format("avro").load(list(paths)), "spark-avro")


def read_jdbc(
    spark: SparkSession,
    url: str,
    *,
    dbtable: str | None = None,
    query: str | None = None,
    partition: tuple[str, Any, Any, int] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table or a query; ``partition`` = (column, lower, upper, parts) reads it in parallel."""
    return _external(lambda: spark.read.format("jdbc").options(**jdbc_options(url, dbtable, query, partition, options)).load(), "a JDBC driver")


def jdbc_options(
    url: str,
    dbtable: str | None = None,
    query: str | None = None,
    partition: tuple[str, Any, Any, int] | None = None,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    if not url or not (dbtable or query):
        raise ValueError("a JDBC read needs a url and a dbtable or query")
    made = {**dict(extra or {}), "url": url, "dbtable": dbtable or f"({query}) AS q"}
    if partition:
        column, lower, upper, parts = partition
        made.update(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return made


def read_kafka(spark: SparkSession, servers: str, topic: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Needs the external Kafka connector on the classpath."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return _external(lambda: reader.options(**dict(options or {})).load(), "the Kafka connector")


def _external(load, needs: str) -> DataFrame:
    try:
        return load()
    except Exception as error:
        raise RuntimeError(f"this source needs {needs} on the Spark classpath: {error}") from error


def parse_value(
    df: DataFrame, column: str, kind: str = "json", schema: str | None = None, mode: str = "FAILFAST"
) -> DataFrame:
    """Parse a message column into ``value_parsed``; raw keeps the text as it is."""
    if kind == "raw":
        return df.withColumn("value_parsed", F.col(column).cast("string"))
    if schema is None:
        raise ValueError("parsing needs a schema")
    if kind == "json":
        return df.withColumn("value_parsed", F.from_json(F.col(column).cast("string"), schema, {"mode": mode}))
    if kind == "avro":
        from pyspark.sql.avro.functions import from_avro

        return _external(lambda: df.withColumn("value_parsed", from_avro(column, schema, {"mode": mode})), "spark-avro")
    raise ValueError(f"unknown value format: {kind}")


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """File references below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    types = F.create_map(*[F.lit(v) for pair in MEDIA_TYPES.items() for v in pair])
    return files.select(
        F.col("path").alias("uri"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.coalesce(F.try_element_at(types, extension), F.lit("application/octet-stream")).alias("content_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def table_page(df: DataFrame, columns: Sequence[str], by: Sequence[str], rows: int) -> DataFrame:
    """The first rows of a total order; a page of more than MAX_PAGE_ROWS rows is refused."""
    if rows > MAX_PAGE_ROWS:
        raise ValueError(f"a page holds at most {MAX_PAGE_ROWS} rows")
    return df.select(*columns).sort(*by).limit(rows)


def extract_after(
    df: DataFrame, watermark: str, last: Any = None, tie: str | None = None, last_tie: Any = None
) -> DataFrame:
    """Rows after the stored position ``(watermark[, tie])``; all rows when there is none."""
    df = df.filter(F.col(watermark).isNotNull())
    if last is None:
        return df
    if tie is None or last_tie is None:
        return df.filter(F.col(watermark) > F.lit(last))
    return df.filter(beyond([watermark, tie], [last, last_tie]))


def position(df: DataFrame, watermark: str, tie: str | None = None) -> DataFrame:
    """One row with the greatest ``(watermark[, tie])``: the next stored position."""
    names = [watermark, *([tie] if tie else [])]
    top = F.max(F.when(F.col(watermark).isNotNull(), F.struct(*names))).alias("_top")
    return df.agg(top).select("_top.*")


def change_token(df: DataFrame, token: str) -> DataFrame:
    """Current greatest change token, from the token column alone."""
    return df.agg(F.max(token).alias("token"))


def sample_random(df: DataFrame, fraction: float, seed: int | None = None, replacement: bool = False) -> DataFrame:
    return df.sample(replacement, fraction, seed)


def sample_stratified(df: DataFrame, column: str, fractions: Mapping[Any, float], seed: int | None = None) -> DataFrame:
    return df.sampleBy(column, dict(fractions), seed)


def _share(key: str) -> Column:
    """A repeatable number in [0, 1) drawn from the row key."""
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def sample_by_key(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Repeatable sample: the same keys are chosen on every run and at every scale."""
    return df.filter(_share(key) < fraction)


def sample_stratified_by_key(df: DataFrame, key: str, column: str, fractions: Mapping[Any, float]) -> DataFrame:
    wanted = F.lit(0.0)
    for value, fraction in fractions.items():
        wanted = F.when(F.col(column) == F.lit(value), F.lit(fraction)).otherwise(wanted)
    return df.filter(_share(key) < wanted)


def head(df: DataFrame, rows: int) -> DataFrame:
    if rows <= 0:
        raise ValueError("rows must be positive")
    return df.limit(rows)
