"""Average active sessions over an unbounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.operators.filters import DEFAULT_REPORT_FILTER
from sessionscope.schema import is_heartbeat, is_session


def windowed_load(
    samples: DataFrame, length: str, lateness: str, predicate: str | Column = DEFAULT_REPORT_FILTER
) -> DataFrame:
    """Sessions and samples per tumbling window of ``dtcol``; works on streams and tables.

    State is two counters per window, so a long ``lateness`` costs little.
    """
    chosen = F.expr(predicate) if isinstance(predicate, str) else predicate
    return (
        samples.withColumn("dtcol", F.col("dtcol").cast("timestamp"))
        .withWatermark("dtcol", lateness)
        .groupBy(F.window("dtcol", length).alias("span"))
        .agg(
            F.count_if(is_session() & chosen).alias("sessions"),
            F.count_if(is_heartbeat()).alias("samples"),
        )
        .select(F.col("span.start").alias("window_start"), "sessions", "samples")
    )


def stream_aas(samples: DataFrame, path: str, checkpoint: str, length: str, lateness: str, **options) -> None:
    """Process what the stream holds now; each batch writes the windows it changed.

    A batch owns one folder, so a batch repeated after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        (
            batch.withColumn("batch", F.lit(number).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    (
        windowed_load(samples, length, lateness, **options)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_aas(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of every window, with its average active sessions."""
    latest = (
        spark.read.parquet(path)
        .groupBy("window_start")
        .agg(F.max_by(F.struct("sessions", "samples"), "batch").alias("last"))
        .select("window_start", "last.*")
    )
    return with_average(latest)


def with_average(loads: DataFrame) -> DataFrame:
    average = F.round(F.try_divide(F.col("sessions"), F.col("samples")).cast("decimal(38,10)"), 2)
    return loads.withColumn("average_active_sessions", average.cast("double"))
