"""Flat files of samples: one row per line, tab separated, ``\\N`` for null.

Backslash, tab, newline and carriage return inside a value are written as two
characters, so a line never holds a value's own tab or line end.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.operators.enrich import fingerprint
from sessionscope.sources.history import append_samples

# Characters written as backslash and letter.
ESCAPES = (("\t", "t"), ("\n", "n"), ("\r", "r"))
NULL = "\\N"
# Stands for a written backslash while the other escapes are undone; no text value holds it.
MARK = "\u0000"


def flat_row(samples: DataFrame) -> DataFrame:
    """The row a flat file holds: the hash only, no blockers, zero CPU, memory and swap."""
    return fingerprint(samples, normalize=False).withColumns(
        {
            "dquery": F.lit(None).cast("string"),
            "blockers": F.lit(None).cast("string"),
            "pourcentage_cpu": F.lit(0.0),
            "mem": F.lit(0).cast("bigint"),
            "swapped": F.lit(0).cast("bigint"),
            "application_info": F.lit(None).cast("string"),
        }
    )


def _written(value: Column) -> Column:
    text = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for character, letter in ESCAPES:
        text = F.replace(text, F.lit(character), F.lit("\\" + letter))
    return F.coalesce(text, F.lit(NULL))


def _read(text: Column) -> Column:
    value = F.replace(text, F.lit("\\\\"), F.lit(MARK))
    for character, letter in ESCAPES:
        value = F.replace(value, F.lit("\\" + letter), F.lit(character))
    return F.when(text != NULL, F.replace(value, F.lit(MARK), F.lit("\\")))


def flat_lines(rows: DataFrame) -> DataFrame:
    """One column ``value``: the line of each row."""
    return rows.select(F.concat_ws("\t", *[_written(F.col(name)) for name in rows.columns]).alias("value"))


def dump_flat(rows: DataFrame, path: str) -> None:
    """Append rows to a folder of flat files."""
    flat_lines(rows).write.mode("append").text(path)


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    parts = F.split("value", "\t")
    return lines.select(
        *[
            _read(F.get(parts, F.lit(position))).cast(field.dataType).alias(field.name)
            for position, field in enumerate(schema)
        ]
    )


def load_flat(
    spark: SparkSession, path: str, schema: T.StructType, table: str, checkpoint: str, options: dict[str, str] | None = None
) -> None:
    """Append the flat files not loaded yet to a history table.

    ``options`` are those of the file source, such as ``maxFilesPerTrigger``. The load writes
    to folders of its own, so it may go on next to samplers and other loads.

    The stream's checkpoint remembers the files taken, so files written meanwhile wait
    for the next load and none is loaded twice, whatever fails in between.
    """
    lines, writer = spark.readStream.options(**(options or {})).text(path), f"flat-{md5(checkpoint.encode()).hexdigest()[:16]}"
    (
        lines.writeStream.foreachBatch(
            lambda batch, number: append_samples(parse_lines(batch, schema), table, writer, number)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
