"""Per-sample enrichment: fingerprints, CPU and memory probes, blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.scalars import (
    application_info,
    normalize_query,
    normalized_hash,
    query_hash,
    query_tokens,
    round_half_even,
)
from sessionscope.functions.stemmer import stemmed
from sessionscope.schema import keys_of

# A time bucket is this many seconds, or this many horizons if that is more.
BUCKET_SECONDS = 3600
BUCKET_HORIZONS = 24


def fingerprint(samples: DataFrame, normalize: bool = True) -> DataFrame:
    """Add ``iquery``, ``tquery`` and ``itquery``; the last two are null without normalizing."""
    result = samples.withColumn("iquery", query_hash(F.col("query")))
    if not normalize:
        return result.withColumns({"tquery": F.lit(None).cast("string"), "itquery": F.lit(None).cast("bigint")})
    return result.withColumn("tquery", normalize_query(F.col("query"))).withColumn(
        "itquery", normalized_hash(F.col("query_id"), F.col("tquery"))
    )


def with_application_info(samples: DataFrame) -> DataFrame:
    return samples.withColumn("application_info", application_info(F.col("application_name")))


def with_query_tokens(samples: DataFrame, stem: bool = False) -> DataFrame:
    """Add ``dquery``, the distinct words of the query; their English stems if ``stem``."""
    if stem:
        return stemmed(samples, "query", query_tokens, "dquery")
    return samples.withColumn("dquery", query_tokens(F.col("query")))


def cpu_per_pid(samples: DataFrame, probes: DataFrame) -> DataFrame:
    """Add ``pourcentage_cpu`` from probes (dtcol, pid, cpu); pid 0 is the whole host."""
    instant = keys_of(samples, "dtcol")
    cpu = probes.select(*instant, F.col("pid").alias("probe_pid"), F.col("cpu").alias("pourcentage_cpu"))
    return (
        samples.drop("pourcentage_cpu")
        .withColumn("probe_pid", F.coalesce("pid", F.lit(0).cast("bigint")))
        .join(cpu, [*instant, "probe_pid"], "left")
        .drop("probe_pid")
    )


def memory_horizon(interval_seconds: int) -> int:
    """Seconds a stored memory value stays good for: two sampling intervals, at least 20."""
    return max(20, 2 * interval_seconds)


def _with_overlap(probes: DataFrame, horizon: int) -> DataFrame:
    """Give each row its time bucket, and a copy in the next one if it still counts there.

    A window per (pid, bucket) then sees the whole horizon before each of its own rows,
    so one long-lived pid is spread over many tasks. Copies have ``own`` = false.
    """
    width = max(BUCKET_SECONDS, BUCKET_HORIZONS * horizon)
    second = F.unix_seconds("dtcol")
    bucket = F.floor(second / width)
    return (
        probes.withColumn("at", F.unix_micros("dtcol"))
        .withColumn("bucket", F.explode(F.sequence(bucket, F.floor((second + horizon) / width))))
        .withColumn("own", F.col("bucket") == F.floor(F.unix_seconds("dtcol") / width))
    )


def _per_pid(probes: DataFrame) -> list[str]:
    return keys_of(probes, "pid")


def recent_memory(probes: DataFrame, interval_seconds: int) -> DataFrame:
    """Add ``recent_mem`` and ``recent_swapped``: averages over the pid's earlier samples.

    Earlier means later than ``dtcol - horizon`` and before ``dtcol``; both bounds are
    exclusive. Null when the pid was not seen in that time.
    """
    horizon = memory_horizon(interval_seconds)
    micros = horizon * 1_000_000
    window = (
        Window.partitionBy(*_per_pid(probes), "bucket").orderBy("at").rangeBetween(-(micros - 1), -1)
    )
    return (
        _with_overlap(probes.filter("pid is not null"), horizon)
        .withColumn("recent_mem", round_half_even(F.avg("mem").over(window)).cast("bigint"))
        .withColumn("recent_swapped", round_half_even(F.avg("swapped").over(window)).cast("bigint"))
        .filter("own")
        .drop("own", "bucket", "at")
    )


def probe_needed(probes: DataFrame, interval_seconds: int) -> DataFrame:
    """(dtcol, pid) without a recent memory value: the processes to probe afresh."""
    horizon = memory_horizon(interval_seconds)
    return _run_starts(probes.select("dtcol", *_per_pid(probes)), horizon, None).filter("own and starts").select(
        "dtcol", *_per_pid(probes)
    )


def _run_starts(probes: DataFrame, horizon: int, fresh: Column | None) -> DataFrame:
    window = Window.partitionBy(*_per_pid(probes), "bucket").orderBy("at")
    starts = F.coalesce(F.col("at") - F.lag("at").over(window) >= horizon * 1_000_000, F.lit(True))
    if fresh is not None:
        starts = starts | fresh
    return _with_overlap(probes.filter("pid is not null"), horizon).withColumn("starts", starts)


def carry_memory(probes: DataFrame, interval_seconds: int, fresh: Column | None = None) -> DataFrame:
    """Replace ``mem`` and ``swapped`` by the value kept since the pid was first seen.

    A stored value feeds the next average, so a pid keeps the first probe of its run
    until it is unseen for the whole horizon. ``fresh`` marks samples that were probed
    anyway and start a new run; that is exact when the horizon reaches back to one
    sample only, which holds for intervals of ten seconds and more.

    Runs are found per (pid, bucket). The value of a run that began in an earlier bucket
    arrives through a second window over one row per (pid, bucket).
    """
    if fresh is not None and memory_horizon(interval_seconds) > 2 * interval_seconds:
        raise ValueError("draws are exact for sampling intervals of ten seconds and more")
    keys = _per_pid(probes)
    rows = _run_starts(probes, memory_horizon(interval_seconds), fresh).filter("own")
    within = Window.partitionBy(*keys, "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    started = F.when(F.col("starts"), F.struct("mem", "swapped"))
    rows = rows.withColumn("kept", F.last(started, ignorenulls=True).over(within))
    across = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "bucket")
        .agg(F.max_by(F.struct("mem", "swapped"), F.when(F.col("starts"), F.col("at"))).alias("last_start"))
        .withColumn("carried", F.last("last_start", ignorenulls=True).over(across))
        .select(*keys, "bucket", "carried")
    )
    kept = F.coalesce("kept", "carried")
    return (
        rows.join(carried, [*keys, "bucket"])
        .withColumns({"mem": kept["mem"], "swapped": kept["swapped"]})
        .select(*probes.columns)
    )


def cache_sampling(samples: DataFrame) -> DataFrame:
    """Per (dtcol, pid): may the cached memory be used? Probability active / 1000, at most 999.

    The draw is a hash of instant and pid, so a lost task redraws the same answer.
    """
    sessions = samples.filter("pid is not null")
    instant = keys_of(samples, "dtcol")
    load = sessions.groupBy(*instant).agg(F.least(F.count("*"), F.lit(999)).alias("active"))
    digest = F.md5(F.concat_ws("|", F.unix_micros("dtcol").cast("string"), F.col("pid").cast("string")))
    draw = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(1000))
    return sessions.select(*instant, "pid").join(load, instant).select(
        *instant, "pid", "active", draw.alias("draw"), (draw < F.col("active")).alias("use_cache")
    )
