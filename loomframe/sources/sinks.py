"""Writers, write modes, versioned datasets and output kinds."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators.transforms import align

# Spellings of "no" in a keep/remove flag column, and known media kinds.
FALSE_FLAGS = ("0", "false", "f", "no", "n", "off")
MEDIA_KINDS = ("image", "video", "audio", "document")
APPENDING = {"append", "always_append", "append_only_new_rows", "changelog"}
SNAPSHOTS = {"overwrite", "snapshot_difference", "snapshot_replace", "snapshot_replace_and_remove"}
GEO_FORMATS = ("wkt", "geojson")


def write_files(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> str:
    """Executors write straight to the target. CSV and JSON cannot be partitioned."""
    if fmt in ("csv", "json") and partition_by:
        raise ValueError(f"{fmt} output cannot be partitioned")
    missing = [c for c in partition_by if c not in df.columns]
    if missing:
        raise ValueError(f"partition columns not in the data: {missing}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def default_mode(streaming: bool = False, incremental: bool = False) -> str:
    """Append for streams and additive increments, otherwise overwrite."""
    return "append" if streaming or incremental else "overwrite"


def _keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def _unique(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None) -> DataFrame:
    """One row per key: the greatest by ``order``, then by the other columns."""
    from loomframe.operators.skew import latest

    rest = [c for c, kind in df.dtypes if c not in keys and "map<" not in kind and "variant" not in kind]
    if not keys:
        return df
    if not rest:
        return df.dropDuplicates(list(keys))
    return latest(df, keys, [*(order or ()), *[c for c in rest if c not in (order or ())]])


def _both(existing: DataFrame, incoming: DataFrame) -> dict[str, str]:
    """Columns of either side, the incoming ones first."""
    return dict(incoming.dtypes) | {c: t for c, t in existing.dtypes if c not in incoming.columns}


def _current(existing: DataFrame, keys: Sequence[str], version: str | None) -> DataFrame:
    """One stored row per key: of the newest version, and there the greatest."""
    return _unique(existing, keys, [version] if version else None).drop(version or "")


def append_only_new_rows(
    existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Deduplicated incoming rows whose key is not there yet."""
    fresh = _unique(incoming, keys, order)
    return fresh if existing is None or not keys else fresh.join(_keys(existing, keys), list(keys), "left_anti")


def changelog(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Incoming rows that are new or differ from the existing row; duplicates in the input stay.

    Of several existing rows of a key the newest by the column ``version`` counts.
    """
    if existing is None or not keys:
        return incoming
    tracked = [c for c in incoming.columns if c not in keys]
    old = align(_current(existing, keys, version), dict(incoming.dtypes))
    old = old.select(*keys, F.struct(F.lit(1).alias("_there"), *tracked).alias("_old"))
    joined = incoming.join(old, list(keys), "left")
    different = [~F.col(c).eqNullSafe(F.col(f"_old.{c}")) for c in tracked]
    keep = reduce(Column.__or__, different, F.col("_old").isNull())
    return joined.filter(keep).select(*incoming.columns)


def snapshot_difference(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not in the existing data, duplicates included."""
    return incoming if existing is None or not keys else incoming.join(_keys(existing, keys), list(keys), "left_anti")


def snapshot_replace(
    existing: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | None = None,
    version: str | None = None,
) -> DataFrame:
    """Upsert: existing rows with untouched keys, plus the deduplicated input.

    The result has the columns of both sides. Of several existing rows of a key the newest by the
    column ``version`` stays.
    """
    fresh = _unique(incoming, keys, order)
    if existing is None or not keys:
        return fresh
    return _upserted(existing, fresh, _keys(fresh, keys), keys, version)


def _upserted(existing: DataFrame, fresh: DataFrame, touched: DataFrame, keys: Sequence[str], version: str | None) -> DataFrame:
    stored = _current(existing, keys, version)
    schema = _both(stored, fresh)
    kept = stored.join(touched, list(keys), "left_anti")
    return align(kept, schema).unionByName(align(fresh, schema))


def snapshot_replace_and_remove(
    existing: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str],
    flag: str,
    order: Sequence[str] | None = None,
    version: str | None = None,
) -> DataFrame:
    """Upsert rows whose flag is truthy and remove keys whose flag says no (false removes).

    A row with a missing flag does neither. Columns and ``version`` as in ``snapshot_replace``.
    """
    says_no = F.lower(F.trim(F.col(flag).cast("string"))).isin(*FALSE_FLAGS)
    fresh = _unique(incoming.filter(~says_no), keys, order)
    if existing is None or not keys:
        return fresh
    gone = incoming.filter(says_no).select(*keys)
    touched = fresh.select(*keys).unionByName(gone).distinct()
    return _upserted(existing, fresh, touched, keys, version)


def resolve(
    mode: str,
    existing: DataFrame | None,
    incoming: DataFrame,
    keys: Sequence[str] = (),
    flag: str | None = None,
    order: Sequence[str] | None = None,
    version: str | None = None,
) -> DataFrame:
    """The rows that a write mode puts down; ``version`` names a column of ``existing``."""
    if mode in ("overwrite", "append", "always_append"):
        return incoming
    if mode == "append_only_new_rows":
        return append_only_new_rows(existing, incoming, keys, order)
    if mode == "changelog":
        return changelog(existing, incoming, keys, version)
    if mode == "snapshot_difference":
        return snapshot_difference(existing, incoming, keys)
    if mode == "snapshot_replace":
        return snapshot_replace(existing, incoming, keys, order, version)
    if mode == "snapshot_replace_and_remove":
        if not flag:
            raise ValueError("snapshot_replace_and_remove needs the flag column")
        return snapshot_replace_and_remove(existing, incoming, keys, flag, order, version)
    raise ValueError(f"unknown write mode: {mode}")


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(version, kind) of every commit, from folder names alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            number, kind = name[1:].split("-", 1)
            found.append((int(number), kind))
    return sorted(found)


def read_dataset(
    spark: SparkSession, root: str, since: int | None = None, as_of: int | None = None, version: str | None = None
) -> DataFrame | None:
    """Current rows of a versioned dataset, or with ``since`` only rows added by later commits.

    Only the needed commit folders are listed and read. Columns are those of any commit read;
    ``version`` adds the number of the commit under that name. None when nothing qualifies.
    """
    commits = [c for c in _versions(spark, root) if as_of is None or c[0] <= as_of]
    if since is not None:
        wanted = [c for c in commits if c[0] > since]
    else:
        starts = [i for i, (_, kind) in enumerate(commits) if kind == "snapshot"]
        wanted = commits[starts[-1] :] if starts else commits
    paths = [f"{root}/v{number:08d}-{kind}" for number, kind in wanted]
    if not paths:
        return None
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    number = F.regexp_extract("_metadata.file_path", r"/v(\d+)-[a-z]+/[^/]*$", 1).cast("bigint")
    return rows.select("*", number.alias(version)) if version else rows


def _making_up(commits: list[tuple[int, str]], as_of: int | None) -> list[tuple[int, str]]:
    """The commits whose files make up a version: from its last snapshot on."""
    known = [c for c in commits if as_of is None or c[0] <= as_of]
    starts = [i for i, (_, kind) in enumerate(known) if kind == "snapshot"]
    return known[starts[-1] :] if starts else known


def _folders(root: str, commits: Sequence[tuple[int, str]]) -> list[str]:
    return [f"{root}/v{number:08d}-{kind}" for number, kind in commits]


def manifest(spark: SparkSession, root: str, as_of: int | None = None) -> DataFrame:
    """(file, version, bytes): the files that make up a version, listed by Spark without reading them."""
    folders = _folders(root, _making_up(_versions(spark, root), as_of))
    if not folders:
        return spark.createDataFrame([], "file string, version bigint, bytes bigint")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folders)
    number = F.regexp_extract("path", r"/v(\d+)-[a-z]+/", 1).cast("bigint")
    return listed.select(F.col("path").alias("file"), number.alias("version"), F.col("length").alias("bytes"))


def file_changes(spark: SparkSession, root: str, since: int, until: int | None = None) -> DataFrame:
    """(file, version, bytes, change): files ``added`` to and ``removed`` from a dataset between two versions."""
    old, new = manifest(spark, root, since), manifest(spark, root, until)
    added = new.join(old.select("file"), "file", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new.select("file"), "file", "left_anti").withColumn("change", F.lit("removed")))


def read_changes(spark: SparkSession, root: str, since: int, until: int | None = None, change: str = "change") -> DataFrame | None:
    """Rows ``added`` and ``removed`` between two versions; a row that changed comes as both.

    Only folders that one of the versions has and the other has not are read. A snapshot writes rows anew: those
    that stood in the files it replaced cancel out, by number of equal rows. Appends alone need no
    comparison. None when both versions have the same files. Rows with map columns cannot be compared.
    """
    commits = _versions(spark, root)
    old, new = _making_up(commits, since), _making_up(commits, until)
    gone, come = [c for c in old if c not in new], [c for c in new if c not in old]
    if not gone and not come:
        return None

    def rows(of: list[tuple[int, str]]) -> DataFrame | None:
        return spark.read.option("mergeSchema", True).parquet(*_folders(root, of)) if of else None

    added, removed = rows(come), rows(gone)
    if removed is None:
        return added.withColumn(change, F.lit("added"))
    both = removed.withColumn("_sign", F.lit(-1))
    if added is not None:
        both = added.withColumn("_sign", F.lit(1)).unionByName(both, allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_sign"]
    counted = both.groupBy(*columns).agg(F.sum("_sign").alias("_n")).filter("_n <> 0")
    kind = F.when(F.col("_n") > 0, F.lit("added")).otherwise(F.lit("removed"))
    return counted.withColumn(change, kind).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int")))).select(*columns, change)


def _claim(spark: SparkSession, root: str, number: int) -> int:
    """The first version number from ``number`` on that no other writer has taken; its marker stays."""
    while True:
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_taken/{number:08d}")
        fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            fs.create(marker, False).close()
            return number
        except Py4JJavaError:
            if not fs.exists(marker):
                raise
            number += 1


def _await(spark: SparkSession, root: str, numbers: range, seconds: float) -> None:
    """Until these versions are complete. A writer that died leaves its marker: remove it to go on."""
    until = time.monotonic() + seconds
    while missing := set(numbers) - {number for number, _ in _versions(spark, root)}:
        if time.monotonic() > until:
            raise TimeoutError(f"versions {sorted(missing)} were taken under {root}/_taken but not written within {seconds} s")
        time.sleep(0.2)


def commit(
    incoming: DataFrame,
    root: str,
    mode: str = "overwrite",
    keys: Sequence[str] = (),
    flag: str | None = None,
    order: Sequence[str] | None = None,
    wait: float = 600,
) -> int | None:
    """Write one new version; earlier versions stay readable. None when an append adds no rows.

    Writers at one time get numbers of their own; neither overwrites the other's folder. A mode that builds on
    stored rows is worked out again where another writer took a number in between, on top of that writer's
    version, so no row is lost; ``wait`` seconds are given to that writer to finish.
    """
    spark = incoming.sparkSession
    commits = _versions(spark, root)
    base = commits[-1][0] if commits else 0
    named = mode == "changelog" or mode.startswith("snapshot_replace")

    def resolved(before: int | None = None) -> DataFrame:
        existing = read_dataset(spark, root, as_of=before, version="_version") if named else read_dataset(spark, root, as_of=before)
        return resolve(mode, existing, incoming, keys, flag, order, "_version" if named else None)

    rows = resolved()
    if mode in APPENDING and commits and rows.isEmpty():
        return None
    number = _claim(spark, root, base + 1)
    if number > base + 1 and mode not in ("overwrite", "append", "always_append"):
        _await(spark, root, range(base + 1, number), wait)
        rows = resolved(number - 1)
    kind = "append" if mode in APPENDING else "snapshot"
    write_files(rows, f"{root}/v{number:08d}-{kind}", mode="errorifexists")
    return number


def write_geotemporal(df: DataFrame, path: str, time: str, geometry: str, fmt: str = "wkt") -> str:
    """Parquet by day of ``time``; the geometry must be WKT or GeoJSON text."""
    if fmt not in GEO_FORMATS:
        raise ValueError(f"geometry format must be one of {GEO_FORMATS}")
    _need(df, [time, geometry])
    return write_files(df.withColumn("day", F.to_date(time)), path, partition_by=["day"])


def write_media(df: DataFrame, path: str, uri: str, kind: str) -> str:
    if kind not in MEDIA_KINDS:
        raise ValueError(f"media kind must be one of {MEDIA_KINDS}")
    _need(df, [uri])
    return write_files(df.withColumn("media_type", F.lit(kind)), path)


def virtual_view(df: DataFrame, name: str) -> DataFrame:
    """A named query that holds no data and is computed on each read."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_entities(df: DataFrame, path: str, entity: str, keys: Sequence[str]) -> str:
    _need(df, keys)
    return write_files(df.withColumn("class_id", F.lit(entity)), path)


def write_links(df: DataFrame, path: str, predicate: str, source: str, target: str) -> str:
    _need(df, [source, target])
    edges = df.select(F.col(source).alias("src"), F.col(target).alias("dst"), F.lit(predicate).alias("predicate"))
    return write_files(edges.distinct(), path)


def _need(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the data: {missing}")
