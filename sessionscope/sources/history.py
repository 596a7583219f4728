"""History tables: Parquet folders by day, writer and batch, on any Hadoop file system.

A table is a path. Every row lies in ``day=.../writer=.../batch=...``. ``day`` is the UTC
date of ``dtcol``, whatever the session's time zone; ``writer`` names who wrote the row, so
samplers, loads and maintenance never touch each other's folders; ``batch`` is one write.
Repeating a batch replaces its own folders.
Maintenance merges the folders of a day into one per writer, ``batch=-1``, whose files keep the
number of each row's batch; ``_merged`` lists these batches, which a repetition then skips. Rows inside a file are sorted by ``dtcol``, so
the day folder and the Parquet statistics do the work of range partitions and block range
indexes. ``_shape`` holds empty files whose merged schema is the table's.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.functions.scalars import instant_from_micros, utc_day, utc_micros

PLACEMENT = ("day", "writer", "batch")
MERGED, MERGED_BATCH = -1, "merged_batch"
PLACES = T.StructType([
    T.StructField("day", T.DateType()), T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())
])


# ---- files


def _folder(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _folder(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_folder(spark, path))


def delete_folder(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_folder(spark, path), True)


def folder_names(spark: SparkSession, pattern: str) -> list[str]:
    found = _files(spark, pattern).globStatus(_folder(spark, pattern)) or []
    return sorted(status.getPath().getName() for status in found)


def partition_days(spark: SparkSession, path: str) -> list[dt.date]:
    """Days a table has a folder for: one name per day of history."""
    return [dt.date.fromisoformat(name.split("=", 1)[1]) for name in folder_names(spark, f"{path}/day=*")]


# ---- shape


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns of a table without its placement, None before the first write."""
    shape = f"{path}/_shape"
    return spark.read.option("mergeSchema", "true").parquet(shape).schema if table_exists(spark, shape) else None


def create_like(spark: SparkSession, source: DataFrame, path: str, derived: T.StructType | None = None) -> DataFrame:
    """Make an empty table with the columns of ``source`` and the derived ones, unless it exists."""
    if table_schema(spark, path) is None:
        extra = [field for field in (derived or T.StructType([])) if field.name not in source.columns]
        _widen(spark, path, T.StructType([*source.schema, *extra]))
    return read_history(spark, path)


def _widen(spark: SparkSession, path: str, schema: T.StructType) -> None:
    fields = [T.StructField(field.name, field.dataType) for field in schema if field.name not in PLACEMENT]
    spark.createDataFrame([], T.StructType(fields)).coalesce(1).write.mode("append").parquet(f"{path}/_shape")


def _aligned(rows: DataFrame, path: str) -> DataFrame:
    """The rows with the table's columns and types; columns new to the table are added to it.

    A column that a writer leaves empty under another type (a flat file knows text only)
    becomes null of the table's type.
    """
    spark = rows.sparkSession
    rows = rows.drop(*PLACEMENT, MERGED_BATCH)
    schema = table_schema(spark, path)
    known = {field.name for field in schema or []}
    new = [field for field in rows.schema if field.name not in known]
    if new:
        _widen(spark, path, T.StructType(new))
        schema = T.StructType([*(schema or []), *new])
    columns = []
    for field in schema:
        if field.name not in rows.columns:
            value = F.lit(None).cast(field.dataType)
        elif rows.schema[field.name].dataType.simpleString() == field.dataType.simpleString():
            value = F.col(field.name)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            value = F.when(F.col(field.name).isNull(), F.lit(None).cast(field.dataType)).otherwise(
                F.raise_error(F.lit(f"{field.name} does not have the table's type")).cast(field.dataType)
            )
        else:
            value = F.col(field.name).cast(field.dataType)
        columns.append(value.alias(field.name))
    return rows.select(*columns)


# ---- reading and appending


def read_history(spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The rows of a table, with ``day``, ``writer`` and ``batch``; of the days given, if any.

    Only the folders of these days are listed, and the schema is the stored one.
    """
    recover(spark, path)
    schema = table_schema(spark, path)
    if schema is None:
        raise FileNotFoundError(f"no history table at {path}")
    days = [
        day for day in partition_days(spark, path) if (first is None or day >= first) and (last is None or day <= last)
    ]
    whole = T.StructType([*schema, *PLACES])
    if not days:
        return spark.createDataFrame([], whole)
    folders = [path] if first is None and last is None else [f"{path}/day={day.isoformat()}" for day in days]
    return _read(spark, path, whole, folders, bool(set(days).intersection(merged_days(spark, path))))


def _read(spark: SparkSession, path: str, whole: T.StructType, paths: list[str], merged: bool, origin: str | None = None) -> DataFrame:
    stored = whole
    if merged:
        fields = [field for field in whole if field.name not in PLACEMENT]
        stored = T.StructType([*fields, T.StructField(MERGED_BATCH, T.LongType()), *PLACES])
    rows = spark.read.schema(stored).option("basePath", path).parquet(*paths)
    if not merged and origin is None:
        return rows
    batch = F.coalesce(MERGED_BATCH, "batch") if merged else F.col("batch")
    more = [F.col("_metadata.file_path").alias(origin)] if origin else []
    return rows.select(*[batch.alias("batch") if name == "batch" else F.col(name) for name in whole.names], *more)


def read_files(spark: SparkSession, path: str, files: list[str], origin: str | None = None) -> DataFrame:
    """The rows of some files of a table, with the name of their file as ``origin``."""
    whole = T.StructType([*table_schema(spark, path), *PLACES])
    if not files:
        return spark.createDataFrame([], T.StructType([*whole, *([T.StructField(origin, T.StringType())] if origin else [])]))
    return _read(spark, path, whole, files, bool(merged_days(spark, path)), origin)


def append_samples(
    samples: DataFrame, path: str, writer: str = "append", batch: int | None = None, lookup: tuple[str, ...] = ()
) -> None:
    """Append samples to a table.

    Rows are gathered by day and rebalanced: a large day is split over many tasks and
    files, small days share one. ``writer`` must be one writer's own name. With ``batch``,
    repeating the writer's batch replaces it, so a restarted stream adds nothing twice;
    without, every call is a batch of its own. ``lookup`` columns get a Parquet bloom
    filter, for searches by equality. Days in which maintenance has merged this batch already
    keep what they have.
    """
    recover(samples.sparkSession, path)
    number = uuid.uuid4().int >> 66 if batch is None else batch
    rows = _aligned(samples, path).withColumns(
        {"day": utc_day("dtcol"), "writer": F.lit(writer), "batch": F.lit(number).cast("bigint")}
    )
    there = [] if batch is None else _merged_already(samples.sparkSession, path, writer, batch)
    if there:
        rows = rows.filter(~F.col("day").isin(there))
    _write(rows, path, lookup)


def _write(rows: DataFrame, path: str, lookup: tuple[str, ...] = ()) -> None:
    rows = rows.hint("rebalance", F.col("day")).sortWithinPartitions(*PLACEMENT, "dtcol")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    for name in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy(*PLACEMENT).parquet(path)


# ---- replacing rows


def replace_rows(spark: SparkSession, path: str, rows: DataFrame, folders: list[str], name: str) -> None:
    """Put ``rows`` (with their placement) in the place of whole folders of the table.

    The rows and the list of folders are written aside first. From then on the change is
    certain: whoever opens the table next finishes it (``recover``), so a failure between
    deleting and writing loses nothing, and doing it twice changes nothing.
    """
    aside = f"{path}/_pending/{name}"
    delete_folder(spark, aside)
    rows.write.parquet(f"{aside}/rows")
    spark.createDataFrame([(folder,) for folder in folders], "folder string").coalesce(1).write.parquet(f"{aside}/folders")
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.parquet(f"{aside}/ready")
    recover(spark, path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish replacements that were begun."""
    for name in folder_names(spark, f"{path}/_pending/*"):
        aside = f"{path}/_pending/{name}"
        if not table_exists(spark, f"{aside}/ready/_SUCCESS"):
            continue
        for row in spark.read.parquet(f"{aside}/folders").collect():
            delete_folder(spark, f"{path}/{row['folder']}")
        _write(spark.read.parquet(f"{aside}/rows"), path)
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("ignore").parquet(f"{path}/_done/{name}")
        delete_folder(spark, aside)


def forget_done(spark: SparkSession, path: str, writer: str, before: int) -> None:
    """Drop the marks of a writer's batches before the given one, which nobody repeats any more."""
    for name in folder_names(spark, f"{path}/_done/{writer}-*"):
        number = name.removeprefix(f"{writer}-")
        if number.isdigit() and int(number) < before:
            delete_folder(spark, f"{path}/_done/{name}")


def is_done(spark: SparkSession, path: str, name: str) -> bool:
    """Whether the replacement of this name has been made."""
    recover(spark, path)
    return table_exists(spark, f"{path}/_done/{name}/_SUCCESS")


def merged_days(spark: SparkSession, path: str) -> list[dt.date]:
    """Days whose folders maintenance has merged."""
    return [dt.date.fromisoformat(name.partition("=")[2]) for name in folder_names(spark, f"{path}/_merged/day=*")]


def _merged_already(spark: SparkSession, path: str, writer: str, batch: int) -> list[dt.date]:
    """Days into which this batch of this writer has been merged."""
    if not merged_days(spark, path):
        return []
    listed = spark.read.schema("writer string, batch long, day date").parquet(f"{path}/_merged")
    found = listed.filter((F.col("writer") == writer) & (F.col("batch") == batch)).select("day").distinct()
    return [row.day for row in found.collect()]


def _rewrite_day(spark: SparkSession, path: str, day: dt.date, keep: Column, purpose: str) -> None:
    """One folder per writer with one day's kept rows in the place of all its folders.

    The list of the merged batches is added to before the folders change, so a batch that is
    repeated from then on is known to be there.
    """
    whole = read_history(spark, path, day, day)
    rows = whole.filter(keep).withColumn(MERGED_BATCH, F.col("batch")).withColumn("batch", F.lit(MERGED).cast("bigint"))
    number = uuid.uuid4().hex[:8]
    aside = f"{path}/_merged/day={day.isoformat()}"
    whole.select("writer", "batch").distinct().coalesce(1).write.mode("append").parquet(aside)
    replace_rows(spark, path, rows, [f"day={day.isoformat()}"], f"{purpose}-{day.isoformat()}-{number}")


def compact(spark: SparkSession, path: str, day: dt.date) -> None:
    """Merge the many small folders of a closed day, one that no writer adds to any more, into one per writer.

    Every row keeps its writer and batch: streams go on from it, and a batch that is repeated
    adds nothing.
    """
    if day in partition_days(spark, path):
        _rewrite_day(spark, path, day, F.lit(True), "compact")


# ---- retention


def _drop_days(spark: SparkSession, path: str, days: list[dt.date]) -> None:
    for day in days:
        delete_folder(spark, f"{path}/day={day.isoformat()}")
        delete_folder(spark, f"{path}/_merged/day={day.isoformat()}")


def retain(spark: SparkSession, path: str, days: int, now: dt.datetime) -> int:
    """Delete rows older than ``days`` days before ``now`` (0 empties the table); return how many.

    ``now`` without a zone is UTC. Whole days go by dropping their folders; the day the
    limit falls in is rewritten aside and then put in place.
    """
    present = partition_days(spark, path)
    if days == 0:
        deleted = read_history(spark, path).count()
        _drop_days(spark, path, present)
        return deleted
    micros = utc_micros(now) - days * 86_400_000_000
    limit, cutoff = dt.date.fromordinal(719_163 + micros // 86_400_000_000), instant_from_micros(micros)
    deleted = read_history(spark, path, last=limit).filter(F.col("dtcol") < cutoff).count()
    _drop_days(spark, path, [day for day in present if day < limit])
    if limit in present and not read_history(spark, path, limit, limit).filter(F.col("dtcol") < cutoff).isEmpty():
        _rewrite_day(spark, path, limit, F.col("dtcol") >= cutoff, "retention")
    return deleted


def retain_all(spark: SparkSession, paths: dict[str, str], days: int, now: dt.datetime) -> dict[str, int]:
    """Retention over every history table that exists; deleted rows per table."""
    return {name: retain(spark, path, days, now) for name, path in paths.items() if table_exists(spark, path)}


def drop_old_partitions(spark: SparkSession, path: str, days: int, now: dt.datetime) -> list[dt.date]:
    """Drop days whose upper bound is at or before the start of ``now``'s (UTC) day minus ``days`` days."""
    today = dt.date.fromordinal(719_163 + utc_micros(now) // 86_400_000_000)
    limit = today - dt.timedelta(days=days)
    old = [day for day in partition_days(spark, path) if day + dt.timedelta(days=1) <= limit]
    _drop_days(spark, path, old)
    return old


def daily_partitions(spark: SparkSession, table: str, start: dt.date, days: int) -> DataFrame:
    """The ``2 * days + 1`` consecutive day ranges from ``start``: name, lower, upper bound."""
    lower = F.date_add(F.lit(start), F.col("id").cast("int"))
    shown = lambda day: F.date_format(day, "yyyy_MM_dd")
    return (
        spark.range(2 * days + 1)
        .select(lower.alias("lower"), F.date_add(lower, 1).alias("upper"))
        .select(
            F.concat_ws("_", F.lit(table), shown(F.col("lower")), shown(F.col("upper"))).alias("partition_name"),
            F.col("lower").cast("timestamp").alias("lower_bound"),
            F.col("upper").cast("timestamp").alias("upper_bound"),
        )
    )


def union_clusters(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of many clusters' rows, with a ``cluster`` column; missing columns are null."""
    parts = [table.withColumn("cluster", F.lit(name)) for name, table in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result
