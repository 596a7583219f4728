"""One query per operator, over the driver's tables.

``QUERIES`` maps a name to a function of (spark, sf_dir). Nothing here limits the
tables read: windows, retention days and top-n are the operators' own arguments.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions import scalars
from sessionscope.operators import counters, enrich, filters, locks, report, rollup, series
from sessionscope.plans.collect import collect, with_blockers
from sessionscope.plans.report import build_interactive_report, build_report, report_lines
from sessionscope.schema import DERIVED_COLUMNS, LOCK_IDENTITY, is_heartbeat
from sessionscope.session import configure, new_folder
from sessionscope.sources import flat_source, flatfile, history, text_index
from sessionscope.sources.fixtures import fixture
from sessionscope.streaming import aas
from sessionscope.streaming import side_tables
from sessionscope.streaming.collect import stream_collect as collect_stream
from sessionscope.streaming.collect import stream_collect_state as collect_stream_state
from sessionscope.streaming.collect import write_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The fixtures hold one sample per hour of thirty days.
INTERVAL = 3600
PLANNED = 720
SERIES_START = dt.datetime(2024, 1, 1)
WINDOW = ("2024-01-05 06:00:00", "2024-01-20 18:00:00")
EVERYTHING = ("1990-01-01 00:00:00", "2030-01-01 00:00:00")
NOW = dt.datetime(2024, 1, 20, 6, 30)
HALFWAY = "2024-01-15 00:00:00"


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def _samples(spark, sf_dir):
    return fixture(spark, sf_dir, "session_samples")


def _enriched(spark, sf_dir):
    return enrich.fingerprint(_samples(spark, sf_dir))


def _history(spark, sf_dir):
    """The enriched samples as a stored table, which is what reports read."""
    path = new_folder(spark, "history")
    history.append_samples(_enriched(spark, sf_dir), path)
    return history.read_history(spark, path)


def _object_locks(spark, sf_dir):
    return fixture(spark, sf_dir, "lock_snapshots")


def _session_locks(spark, sf_dir):
    return fixture(spark, sf_dir, "session_locks")


def _io(spark, sf_dir):
    return fixture(spark, sf_dir, "io_stats")


def _host(spark, sf_dir):
    return fixture(spark, sf_dir, "host_counters")


def _cluster(spark, sf_dir):
    return fixture(spark, sf_dir, "cluster_information")


def _memory_probes(spark, sf_dir):
    return _samples(spark, sf_dir).filter("pid is not null").select("dtcol", "pid", "mem", "swapped")


def _cpu_probes(spark, sf_dir):
    return _samples(spark, sf_dir).select(
        "dtcol",
        F.coalesce("pid", F.lit(0).cast("bigint")).alias("pid"),
        F.col("pourcentage_cpu").alias("cpu"),
    )


def _stored(spark, sf_dir, label):
    """A history table holding the samples."""
    path = new_folder(spark, label)
    history.append_samples(_samples(spark, sf_dir), path)
    return path


# ---- scans, sources, sinks


@query
def window_scan(spark, sf_dir):
    return filters.window_scan(_samples(spark, sf_dir), *WINDOW).select("dtcol", "pid", "wait_event_type", "mem")


@query
def window_scan_day_table(spark, sf_dir):
    """A stored table, read by a session in another time zone than its writer's."""
    path = _stored(spark, sf_dir, "zones")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        first, last = (dt.datetime.fromisoformat(end).replace(tzinfo=dt.timezone.utc) for end in WINDOW)
        found = filters.window_scan(history.read_history(spark, path), first, last).select("dtcol", "pid", "mem")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    return found


@query
def compact_days(spark, sf_dir):
    path = new_folder(spark, "compact")
    samples = _samples(spark, sf_dir)
    history.append_samples(filters.session_rows(samples), path, "one", 1)
    history.append_samples(filters.host_rows(samples), path, "two", 1)
    for day in (SERIES_START.date(), SERIES_START.date() + dt.timedelta(days=1)):
        history.compact(spark, path, day)
    merged = F.col("day").isin(history.merged_days(spark, path))
    return history.read_history(spark, path).select("dtcol", "pid", "mem", merged.alias("merged"))


@query
def append_samples(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    path = new_folder(spark, "append")
    history.append_samples(filters.session_rows(samples), path)
    history.append_samples(filters.host_rows(samples), path)
    return history.read_history(spark, path).select(
        "dtcol", "pid", "datname", "query", "mem", F.date_format("day", "yyyy-MM-dd").alias("day")
    )


@query
def create_like(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    path = new_folder(spark, "like")
    history.create_like(spark, samples, path, DERIVED_COLUMNS)
    history.create_like(spark, samples, path, DERIVED_COLUMNS)
    history.append_samples(samples, path)
    return (
        history.read_history(spark, path)
        .groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count("*").alias("samples"),
            F.count("pourcentage_cpu").alias("with_cpu"),
            F.count("iquery").alias("with_hash"),
        )
    )


@query
def daily_partitions(spark, sf_dir):
    ranges = history.daily_partitions(spark, "session_samples", SERIES_START.date(), 20)
    days = _samples(spark, sf_dir).groupBy(F.date_trunc("day", "dtcol").alias("lower_bound")).agg(
        F.count("*").alias("samples")
    )
    return ranges.join(days, "lower_bound", "left").select(
        "partition_name", "lower_bound", "upper_bound", F.coalesce("samples", F.lit(0)).alias("samples")
    )


def _flat_rows(spark, sf_dir):
    return flatfile.flat_row(filters.not_idle(filters.active_sessions(_samples(spark, sf_dir))))


@query
def dump_flat(spark, sf_dir):
    path = new_folder(spark, "flat")
    flatfile.dump_flat(_flat_rows(spark, sf_dir), path)
    return spark.read.text(path)


@query
def load_flat(spark, sf_dir):
    rows = _flat_rows(spark, sf_dir)
    path, table, checkpoint = (new_folder(spark, label) for label in ("flat", "loaded", "offsets"))
    for part in (rows.filter(F.col("dtcol") < HALFWAY), rows.filter(F.col("dtcol") >= HALFWAY)):
        flatfile.dump_flat(part, path)
        flatfile.load_flat(spark, path, rows.schema, table, checkpoint)
    return history.read_history(spark, table).select(
        "dtcol", "pid", "application_name", "query", "iquery", "tquery", "pourcentage_cpu", "mem"
    )


@query
def flat_source_stream(spark, sf_dir):
    """Flat files written in two jobs through the data source and followed by a stream of it; then read as a table."""
    rows = _flat_rows(spark, sf_dir)
    path, table, checkpoint = (new_folder(spark, label) for label in ("flat", "followed", "offsets"))
    flat_source.register(spark)
    for part in (rows.filter(F.col("dtcol") < HALFWAY), rows.filter(F.col("dtcol") >= HALFWAY)):
        part.write.format("flat_samples").mode("append").save(path)
        stream = spark.readStream.format("flat_samples").schema(rows.schema).load(path)
        (
            stream.writeStream.foreachBatch(lambda batch, number: history.append_samples(batch, table, "flat", number))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        )
    followed = history.read_history(spark, table).select("dtcol", "pid", "query", "iquery", F.lit("stream").alias("read"))
    whole = spark.read.format("flat_samples").schema(rows.schema).load(path)
    return followed.unionByName(whole.select("dtcol", "pid", "query", "iquery", F.lit("table").alias("read")))


@query
def two_flat_folders_one_table(spark, sf_dir):
    """Two folders of flat files, each with a load of its own, into the table a sampler writes too."""
    rows = _flat_rows(spark, sf_dir)
    table = new_folder(spark, "loaded")
    history.append_samples(_samples(spark, sf_dir), table, "sampler", 0)
    for label in ("first", "second"):
        path, checkpoint = new_folder(spark, label), new_folder(spark, "offsets")
        flatfile.dump_flat(rows, path)
        for _ in range(2):  # a second load of the same folder adds nothing
            flatfile.load_flat(spark, path, rows.schema, table, checkpoint)
    return history.read_history(spark, table).select("dtcol", "pid", "query", "iquery", "pourcentage_cpu", "mem")


@query
def parse_counters(spark, sf_dir):
    return counters.parsed_counters(
        fixture(spark, sf_dir, "host_times_text"), "raw", ["user", "nice", "system", "idle"]
    )


@query
def retain(spark, sf_dir):
    path = _stored(spark, sf_dir, "retain")
    deleted = history.retain(spark, path, 7, NOW)
    return history.read_history(spark, path).select("dtcol", "pid", "mem", F.lit(deleted).cast("bigint").alias("deleted"))


@query
def drop_old_partitions(spark, sf_dir):
    path = _stored(spark, sf_dir, "drop")
    history.drop_old_partitions(spark, path, 7, NOW)
    return history.read_history(spark, path).select("dtcol", "pid", "mem")


@query
def union_clusters(spark, sf_dir):
    samples = _samples(spark, sf_dir).select("dtcol", "pid", "datname", "mem")
    return history.union_clusters({"east": samples, "west": samples.drop("mem")})


# ---- filters and predicates


@query
def active_sessions(spark, sf_dir):
    return filters.active_sessions(_samples(spark, sf_dir), own_pid=1001).select("dtcol", "pid", "state")


@query
def pid_filter(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    waiting = samples.filter("wait_event_type = 'Lock'")
    return filters.pid_filter(samples, waiting).select("dtcol", "pid", "wait_event_type")


@query
def not_idle(spark, sf_dir):
    return filters.not_idle(_samples(spark, sf_dir)).select("dtcol", "pid", "wait_event_type")


@query
def report_filter(spark, sf_dir):
    return filters.report_filter(_samples(spark, sf_dir)).select("dtcol", "pid", "application_name", "backend_type")


@query
def host_rows(spark, sf_dir):
    return filters.host_rows(_samples(spark, sf_dir)).select("dtcol", "pourcentage_cpu")


@query
def session_rows(spark, sf_dir):
    return filters.session_rows(_samples(spark, sf_dir)).select("dtcol", "pid", "pourcentage_cpu")


@query
def text_filter(spark, sf_dir):
    return filters.text_filter(_samples(spark, sf_dir), ["purchase", "limit"]).select("dtcol", "pid", "query")


@query
def text_search(spark, sf_dir):
    """Searches by a text index that knows the first half of the table's days, one of them merged since."""
    samples, path = _samples(spark, sf_dir), new_folder(spark, "searched")
    history.append_samples(samples.filter(F.col("dtcol") < HALFWAY), path)
    text_index.update_index(spark, path)
    history.append_samples(samples.filter(F.col("dtcol") >= HALFWAY), path)
    history.compact(spark, path, SERIES_START.date())
    both = text_index.text_search(spark, path, ["purchase", "41"])
    some = text_index.text_search(spark, path, ["7", "error"], every=False, start=WINDOW[0], end=WINDOW[1])
    return both.select("dtcol", "pid", F.lit("both").alias("search")).unionByName(some.select("dtcol", "pid", F.lit("any").alias("search")))


@query
def same_reset(spark, sf_dir):
    return counters.unreset_pairs(_io(spark, sf_dir))


# ---- joins and the lock graph


@query
def wait_edges(spark, sf_dir):
    return locks.wait_edges(_object_locks(spark, sf_dir)).select(
        "dtcol", *LOCK_IDENTITY, "pid", "waiting", "blocked", "blockers"
    )


@query
def root_edges(spark, sf_dir):
    return locks.root_edges(_object_locks(spark, sf_dir))


@query
def blocking_chains(spark, sf_dir):
    return locks.blocking_chains(_object_locks(spark, sf_dir), folder=new_folder(spark, "locks"))


def _waiting(spark, sf_dir):
    """The processes that wait at each instant."""
    locked = _object_locks(spark, sf_dir).filter("not granted and pid is not null")
    return locked.select("dtcol", "pid").distinct()


@query
def blockers_of(spark, sf_dir):
    return locks.blockers_of(_object_locks(spark, sf_dir), _waiting(spark, sf_dir))


@query
def chains_of(spark, sf_dir):
    return locks.chains_of(_object_locks(spark, sf_dir), _waiting(spark, sf_dir), folder=new_folder(spark, "locks"))


@query
def final_blockers(spark, sf_dir):
    return locks.final_blockers(_object_locks(spark, sf_dir), folder=new_folder(spark, "locks")).select(
        "dtcol", "blocked", F.array_join("final_blockers", ",").alias("final_blockers")
    )


@query
def final_blockers_deep(spark, sf_dir):
    return locks.final_blockers(_object_locks(spark, sf_dir), depth=4, folder=new_folder(spark, "locks")).select(
        "dtcol", "blocked", F.array_join("final_blockers", ",").alias("final_blockers")
    )


@query
def session_blockers(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    blockers = locks.final_blockers(
        _session_locks(spark, sf_dir), blocked_in=filters.not_idle(samples), folder=new_folder(spark, "locks")
    )
    return blockers.select("dtcol", "blocked", F.array_join("final_blockers", ",").alias("final_blockers"))


ENRICHED_COLUMNS = (
    "dtcol", "pid", "iquery", "tquery", "itquery", "pourcentage_cpu", "mem", "swapped",
)


@query
def enrich_samples(spark, sf_dir):
    rows = collect(
        _samples(spark, sf_dir),
        _session_locks(spark, sf_dir),
        _cpu_probes(spark, sf_dir),
        _memory_probes(spark, sf_dir),
        INTERVAL,
        folder=new_folder(spark, "locks"),
    )
    return rows.select(
        *ENRICHED_COLUMNS,
        F.array_join("blockers", ",").alias("blockers"),
        F.col("application_info")["action"].alias("action"),
    )


@query
def collect_pids(spark, sf_dir):
    """Chosen processes only, the sampler's own left out."""
    samples = _samples(spark, sf_dir)
    rows = collect(
        samples, _session_locks(spark, sf_dir), _cpu_probes(spark, sf_dir), _memory_probes(spark, sf_dir), INTERVAL,
        pids=samples.filter("wait_event_type = 'Lock'"), own_pid=1001,
        folder=new_folder(spark, "locks"),
    )
    return rows.select(*ENRICHED_COLUMNS, F.array_join("blockers", ",").alias("blockers"))


@query
def collect_plain(spark, sf_dir):
    """Without normalizing and application fields."""
    rows = collect(
        _samples(spark, sf_dir), None, _cpu_probes(spark, sf_dir), _memory_probes(spark, sf_dir), INTERVAL,
        normalize=False, application_fields=False,
    )
    return rows.select(*ENRICHED_COLUMNS, F.col("application_info").isNull().alias("no_fields"))


def _clusters(spark, sf_dir, name):
    """The table of two clusters with equal pids and instants; the west has every value doubled where it can."""
    east = fixture(spark, sf_dir, name)
    west = east
    for column in ("mem", "swapped", "user_s"):
        if column in west.columns:
            west = west.withColumn(column, F.col(column) * 2)
    return history.union_clusters({"east": east, "west": west})


@query
def collect_clusters(spark, sf_dir):
    samples = _clusters(spark, sf_dir, "session_samples")
    cpu = samples.select(
        "cluster", "dtcol", F.coalesce("pid", F.lit(0).cast("bigint")).alias("pid"), F.col("pourcentage_cpu").alias("cpu")
    )
    # the west has no locks
    held = history.union_clusters({"east": _session_locks(spark, sf_dir)})
    rows = collect(samples, held, cpu, samples.filter("pid is not null"), INTERVAL, folder=new_folder(spark, "locks"))
    return rows.select("cluster", *ENRICHED_COLUMNS, F.array_join("blockers", ",").alias("blockers"))


@query
def final_blockers_clusters(spark, sf_dir):
    found = locks.final_blockers(_clusters(spark, sf_dir, "lock_snapshots"), folder=new_folder(spark, "locks"))
    return found.select("cluster", "dtcol", "blocked", F.array_join("final_blockers", ",").alias("final_blockers"))


@query
def report_clusters(spark, sf_dir):
    samples = _clusters(spark, sf_dir, "session_samples")
    peaks = report.peak_sum(filters.session_rows(samples), ["datname"], "mem")
    summary = report.activity(samples).select("cluster", "db_time", "average_active_sessions", "host_cpu")
    times = counters.host_summary(_clusters(spark, sf_dir, "host_counters"), _clusters(spark, sf_dir, "cluster_information"))
    lines = summary.join(times.select("cluster", "user_time", "io_time"), "cluster")
    shown = lambda *names: F.concat_ws("; ", *[F.col(name).cast("decimal(38,2)").cast("string") for name in names])
    return lines.select(
        "cluster", shown("db_time", "average_active_sessions", "host_cpu", "user_time", "io_time").alias("line")
    ).unionByName(peaks.select(F.col("datname").alias("cluster"), F.col("peak_mem").cast("string").alias("line")))


@query
def blocking_sessions(spark, sf_dir):
    found = locks.blocking_sessions(_samples(spark, sf_dir), _session_locks(spark, sf_dir), own_pid=1001)
    return found.select("dtcol", "pid", "usename", "query")


@query
def blocking_prepared(spark, sf_dir):
    return locks.blocking_prepared(
        fixture(spark, sf_dir, "lock_snapshots"), fixture(spark, sf_dir, "prepared_xacts")
    )


@query
def blocking_prepared_snapshots(spark, sf_dir):
    return locks.blocking_prepared(
        fixture(spark, sf_dir, "lock_snapshots"), fixture(spark, sf_dir, "prepared_snapshots")
    )


@query
def probe_needed(spark, sf_dir):
    return enrich.probe_needed(_memory_probes(spark, sf_dir), INTERVAL)


@query
def endpoint_join(spark, sf_dir):
    return counters.endpoint_join(_io(spark, sf_dir), ["reads", "read_time"], ["backend_type", "context"])


# ---- sample enrichment


@query
def query_hash(spark, sf_dir):
    return _samples(spark, sf_dir).select("dtcol", "pid", scalars.query_hash(F.col("query")).alias("iquery"))


@query
def normalize_query(spark, sf_dir):
    return _samples(spark, sf_dir).select(
        "dtcol", "pid", "query", scalars.normalize_query(F.col("query")).alias("tquery")
    )


@query
def normalized_hash(spark, sf_dir):
    return _enriched(spark, sf_dir).select("dtcol", "pid", "itquery")


@query
def application_info(spark, sf_dir):
    info = enrich.with_application_info(_samples(spark, sf_dir)).filter("application_info is not null")
    return info.select("dtcol", "pid", F.explode("application_info").alias("field", "value"))


@query
def query_tokens(spark, sf_dir):
    tokens = F.array_join(scalars.query_tokens(F.col("query")), " ")
    return _samples(spark, sf_dir).select("dtcol", "pid", tokens.alias("dquery"))


@query
def query_stems(spark, sf_dir):
    """The distinct stems of every query, and those that a search for other forms of two words finds."""
    samples = enrich.with_query_tokens(_samples(spark, sf_dir), stem=True)
    hits = filters.text_filter(samples, ["purchasing", "limited"], stem=True).select("dtcol", "pid", F.lit("purchasing limited").alias("dquery"))
    return samples.select("dtcol", "pid", F.array_join("dquery", " ").alias("dquery")).unionByName(hits)


@query
def cpu_per_pid(spark, sf_dir):
    samples = enrich.cpu_per_pid(_samples(spark, sf_dir), _cpu_probes(spark, sf_dir))
    return samples.select("dtcol", "pid", "pourcentage_cpu")


@query
def recent_memory(spark, sf_dir):
    return enrich.recent_memory(_memory_probes(spark, sf_dir), INTERVAL)


@query
def carry_memory(spark, sf_dir):
    return enrich.carry_memory(_memory_probes(spark, sf_dir), INTERVAL)


@query
def cache_sampling(spark, sf_dir):
    return enrich.cache_sampling(_samples(spark, sf_dir))


@query
def query_prefix(spark, sf_dir):
    prefix = scalars.query_prefix(F.col("tquery"), F.col("query"))
    return _enriched(spark, sf_dir).select("dtcol", "pid", prefix.alias("query"))


@query
def hash_hex(spark, sf_dir):
    return _enriched(spark, sf_dir).select(
        "dtcol", "pid", scalars.hash_hex(F.coalesce("itquery", "iquery")).alias("hash")
    )


@query
def size_pretty(spark, sf_dir):
    # the negative square reaches the larger units
    sizes = _samples(spark, sf_dir).select("dtcol", "pid", "mem", "swapped")
    return sizes.select(
        "dtcol",
        "pid",
        scalars.size_pretty(F.col("mem")).alias("mem"),
        scalars.size_pretty(F.col("swapped")).alias("swapped"),
        scalars.size_pretty(-F.col("swapped") * F.col("swapped")).alias("squared"),
    )


@query
def memory_setting(spark, sf_dir):
    size = scalars.memory_setting(F.col("unit"), F.col("setting"))
    return fixture(spark, sf_dir, "settings").select(
        "name", size.alias("bytes"), scalars.size_pretty(size).alias("pretty")
    )


@query
def database_list(spark, sf_dir):
    return series.database_list(fixture(spark, sf_dir, "database_sizes"))


# ---- reports


@query
def report_bounds(spark, sf_dir):
    return report.report_bounds(_samples(spark, sf_dir))


@query
def report_host(spark, sf_dir):
    return report.report_host(_cluster(spark, sf_dir))


@query
def db_time(spark, sf_dir):
    return report.db_time(_samples(spark, sf_dir))


@query
def host_cpu_avg(spark, sf_dir):
    return report.host_cpu_avg(_samples(spark, sf_dir))


@query
def cpu_time_delta(spark, sf_dir):
    return counters.cpu_time_delta(_host(spark, sf_dir), _cluster(spark, sf_dir))


@query
def memory_stats(spark, sf_dir):
    return counters.memory_stats(_host(spark, sf_dir))


@query
def swap_stats(spark, sf_dir):
    return counters.swap_stats(_host(spark, sf_dir))


@query
def swapped_bytes(spark, sf_dir):
    return counters.swapped_bytes(_host(spark, sf_dir))


@query
def io_latency(spark, sf_dir):
    return counters.io_latency(_io(spark, sf_dir))


@query
def io_evictions(spark, sf_dir):
    return counters.io_evictions(_io(spark, sf_dir))


@query
def top_events(spark, sf_dir):
    return report.top_events(_samples(spark, sf_dir), n=3)


@query
def top_queries(spark, sf_dir):
    return report.top_queries(_history(spark, sf_dir), n=10)


@query
def top_queries_summary(spark, sf_dir):
    """The same by a summary of frequent groups, one that proves its result and one too small for it."""
    samples = _history(spark, sf_dir)
    large, small = (report.top_queries(samples, n=10, tracked=tracked) for tracked in (20_000, 16))
    return large.withColumn("tracked", F.lit(20_000)).unionByName(small.withColumn("tracked", F.lit(16)))


@query
def blocking_paths(spark, sf_dir):
    """Every descent from the root blockers at the instants of one month, with its path."""
    locked = _object_locks(spark, sf_dir)
    at = [dt.datetime(1995, 3, day) for day in range(1, 32)]
    paths = locks.blocking_paths(locked, at, depth=2)
    return paths.select("dtcol", "blocked", "blocker", "top_blocker", F.array_join("path", ",").alias("path"), "cycle", "level")


@query
def deadlocks(spark, sf_dir):
    """Processes that wait in circles, in both lock tables."""
    found = [locks.deadlocks(table).withColumn("source", F.lit(name)) for name, table in
             (("object", _object_locks(spark, sf_dir)), ("session", _session_locks(spark, sf_dir)))]
    return found[0].unionByName(found[1])


@query
def non_cpu_pct(spark, sf_dir):
    sessions = filters.session_rows(_samples(spark, sf_dir))
    return sessions.groupBy("datname", "wait_event_type").agg(
        report.non_cpu_pct(F.avg("pourcentage_cpu")).alias("non_cpu_pct")
    )


@query
def peak_sum(spark, sf_dir):
    return report.peak_sum(filters.session_rows(_samples(spark, sf_dir)), ["datname", "usename"], "mem")


@query
def busy_sessions(spark, sf_dir):
    blockers = locks.final_blockers(_session_locks(spark, sf_dir), folder=new_folder(spark, "locks"))
    samples = with_blockers(_enriched(spark, sf_dir), blockers)
    return report.busy_sessions(samples, PLANNED).withColumn("blockers", F.array_join("blockers", ","))


@query
def busy_by(spark, sf_dir):
    samples = enrich.with_application_info(_enriched(spark, sf_dir))
    columns = "datname AS db, tquery AS shape, itquery, application_info['action'] AS action"
    return report.busy_by(samples, columns, PLANNED)


@query
def busy_total(spark, sf_dir):
    return report.busy_total(_samples(spark, sf_dir), PLANNED)


CHOICES = ("datname AS label", "usename AS label", "wait_event_type AS label")


@query
def busy_after_stop(spark, sf_dir):
    """The ranking of a collection that stopped early, by the samples that were taken."""
    samples = _samples(spark, sf_dir).filter(is_heartbeat() | (F.col("wait_event_type") == "Lock"))
    taken = series.effective_iterations(samples, None, 2)
    return report.busy_by(series.stop_after_empty(samples, None, 2), "datname AS db", taken)


@query
def busy_ranked(spark, sf_dir):
    return report.busy_ranked(_samples(spark, sf_dir), list(CHOICES), PLANNED)


@query
def busy_multi(spark, sf_dir):
    rankings = report.busy_multi(_samples(spark, sf_dir), list(CHOICES), PLANNED)
    result = None
    for columns, ranking in zip(CHOICES, rankings):
        part = ranking.withColumn("choice", F.lit(columns.split()[0]))
        result = part if result is None else result.unionByName(part)
    return result


@query
def distinct_executions(spark, sf_dir):
    return report.distinct_executions(filters.session_rows(_samples(spark, sf_dir)), ["datname", "usename"])


def _report_sections(spark, sf_dir):
    return build_report(
        _history(spark, sf_dir),
        _cluster(spark, sf_dir),
        _host(spark, sf_dir),
        _io(spark, sf_dir),
        *EVERYTHING,
        n=10,
    )


@query
def full_report(spark, sf_dir):
    return report_lines(_report_sections(spark, sf_dir))


QUERIES["report"] = QUERIES.pop("full_report")


@query
def interactive_report(spark, sf_dir):
    sections = build_interactive_report(
        _history(spark, sf_dir),
        _cluster(spark, sf_dir),
        _host(spark, sf_dir),
        _io(spark, sf_dir),
        list(CHOICES),
        PLANNED,
    )
    return report_lines(sections)


# ---- the sampling series


@query
def thin_snapshots(spark, sf_dir):
    return series.thin_snapshots(_io(spark, sf_dir), 10).select("dtcol", "backend_type", "context", "reads")


@query
def thin_inventory(spark, sf_dir):
    return series.thin_snapshots(_samples(spark, sf_dir), 100).select("dtcol", "pid")


@query
def thin_ends(spark, sf_dir):
    return series.thin_snapshots(_samples(spark, sf_dir), None).select("dtcol", "pid")


def _lock_waits(spark, sf_dir):
    planned = series.planned_instants(spark, SERIES_START, PLANNED, INTERVAL)
    return _samples(spark, sf_dir).filter("wait_event_type = 'Lock'"), planned


@query
def stop_after_empty(spark, sf_dir):
    waits, planned = _lock_waits(spark, sf_dir)
    return series.stop_after_empty(waits, planned, 2).select("dtcol", "pid")


@query
def effective_iterations(spark, sf_dir):
    waits, planned = _lock_waits(spark, sf_dir)
    return series.effective_iterations(waits, planned, 2)


def _inventory_host(sizes):
    return sizes.groupBy("dtcol").agg(
        F.concat(F.lit("host"), (F.count("*") % 3).cast("string")).alias("cluster_hostname"),
        F.lit("Linux").alias("cluster_os_family"),
        F.lit("16").alias("cluster_postgres_version"),
        F.count("*").cast("int").alias("cluster_processes"),
    )


@query
def stop_after_empty_heartbeats(spark, sf_dir):
    samples = _samples(spark, sf_dir).filter(is_heartbeat() | (F.col("wait_event_type") == "Lock"))
    return series.stop_after_empty(samples, None, 2).select("dtcol", "pid")


@query
def cluster_info_dated(spark, sf_dir):
    sizes = fixture(spark, sf_dir, "database_sizes")
    host = _inventory_host(sizes)
    found = series.cluster_info(sizes, host, fixture(spark, sf_dir, "dated_settings"), every=10)
    return found.select("dtcol", "cluster_hostname", "cluster_port", "cluster_archive_mode", "cluster_shared_buffers")


@query
def cluster_info(spark, sf_dir):
    sizes = fixture(spark, sf_dir, "database_sizes")
    host = _inventory_host(sizes)
    names = {"setting_0": "shared_buffers", "setting_1": "port", "setting_2": "archive_mode"}
    settings = fixture(spark, sf_dir, "settings").replace(names, subset="name")
    return series.cluster_info(sizes, host, settings, every=100, comment="inventory")


@query
def database_stats(spark, sf_dir):
    path = new_folder(spark, "databases")
    history.append_samples(fixture(spark, sf_dir, "database_sizes"), path)
    return history.read_history(spark, path).select("dtcol", "datname", "size_bytes", "is_template")


def _drops(spark, sf_dir, label):
    """Raw samples arriving in two drops; yields the stream over the folder after each."""
    samples = _samples(spark, sf_dir)
    folder = new_folder(spark, label)
    for part in (samples.filter(F.col("dtcol") < HALFWAY), samples.filter(F.col("dtcol") >= HALFWAY)):
        part.write.mode("append").parquet(folder)
        yield spark.readStream.schema(samples.schema).parquet(folder)


@query
def stream_collect(spark, sf_dir):
    table, checkpoint = new_folder(spark, "history"), new_folder(spark, "offsets")
    for stream in _drops(spark, sf_dir, "raw"):
        collect_stream(stream, table, checkpoint, INTERVAL, locks=_session_locks(spark, sf_dir))
    return history.read_history(spark, table).select(
        *ENRICHED_COLUMNS, F.array_join("blockers", ",").alias("blockers")
    )


def _stored_rows(spark, table):
    return history.read_history(spark, table).select(
        *ENRICHED_COLUMNS, F.array_join("blockers", ",").alias("blockers")
    )


@query
def two_streams_one_table(spark, sf_dir):
    """Two samplers over the same days into one table."""
    table = new_folder(spark, "history")
    for label in ("first", "second"):
        checkpoint = new_folder(spark, "offsets")
        for stream in _drops(spark, sf_dir, label):
            collect_stream(stream, table, checkpoint, INTERVAL)
    return _stored_rows(spark, table)


@query
def stream_after_append(spark, sf_dir):
    table = new_folder(spark, "history")
    history.append_samples(_samples(spark, sf_dir), table)
    for stream in _drops(spark, sf_dir, "raw"):
        collect_stream(stream, table, f"{table}-offsets", INTERVAL)
    return _stored_rows(spark, table)


@query
def stream_after_create_like(spark, sf_dir):
    table = new_folder(spark, "history")
    history.create_like(spark, _samples(spark, sf_dir), table, DERIVED_COLUMNS)
    for stream in _drops(spark, sf_dir, "raw"):
        collect_stream(stream, table, f"{table}-offsets", INTERVAL)
    return _stored_rows(spark, table)


@query
def stream_interleaved(spark, sf_dir):
    """Even hours, then odd hours: late samples correct the memory of rows already stored."""
    samples = _samples(spark, sf_dir)
    table, folder = new_folder(spark, "history"), new_folder(spark, "raw")
    for rest in (0, 1):
        samples.filter(F.hour("dtcol") % 2 == rest).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(samples.schema).parquet(folder)
        collect_stream(stream, table, f"{table}-offsets", INTERVAL, locks=_session_locks(spark, sf_dir))
    return _stored_rows(spark, table)


@query
def stream_aas(spark, sf_dir):
    path, checkpoint = new_folder(spark, "load"), new_folder(spark, "offsets")
    for stream in _drops(spark, sf_dir, "raw"):
        aas.stream_aas(stream, path, checkpoint, length="1 day", lateness="3650 days")
    return aas.read_aas(spark, path)


# ---- keyed state on streams


@query
def stream_side_tables(spark, sf_dir):
    """Every side table of the loop at its own rhythm, over two drops with a restart between them."""
    loop = {name: fixture(spark, sf_dir, f"loop_{name}") for name in ("io", "sizes", "locks", "prepared")}
    settings = fixture(spark, sf_dir, "settings").filter("name <> ''").replace({"setting_1": "port"}, subset="name")
    folder = new_folder(spark, "loop")
    path = {name: f"{folder}/{name}" for name in ("ticks", "io", "inventory", "databases", "sessions", "prepared", "ends")}
    for stream in _drops(spark, sf_dir, "raw"):
        tables = [
            side_tables.io_table(path["io"], loop["io"]),
            side_tables.inventory_table(path["inventory"], loop["sizes"], _inventory_host(loop["sizes"]), settings, "loop"),
            side_tables.snapshot_table(path["databases"], loop["sizes"]),
            side_tables.blocking_sessions_table(path["sessions"], _samples(spark, sf_dir), loop["locks"], own_pid=1001),
            side_tables.blocking_prepared_table(path["prepared"], loop["locks"], loop["prepared"]),
            side_tables.snapshot_table(path["ends"], loop["io"], every=None),
        ]
        side_tables.stream_side_tables(stream, path["ticks"], f"{folder}/offsets", tables, iterations=PLANNED)
    shown = {
        "ticks": ["i", "sessions"], "io": ["context", "reads", "writes"], "databases": ["datname", "size_bytes"],
        "inventory": ["cluster_hostname", "cluster_port", "cluster_pretty_size", "cluster_databases", "cluster_processes"],
        "sessions": ["pid", "usename"], "prepared": ["transaction_id", "gid"], "ends": ["context", "reads"],
    }
    result = None
    for name, columns in shown.items():
        line = F.concat_ws("; ", *[F.col(column).cast("string") for column in columns])
        part = history.read_history(spark, path[name]).select(F.lit(name).alias("side"), "dtcol", line.alias("line"))
        result = part if result is None else result.unionByName(part)
    return result


def _two_series(spark, sf_dir):
    """Heartbeats in both clusters; the east has sessions that wait for locks, the west those that wait for I/O."""
    samples = _samples(spark, sf_dir)
    kept = lambda kind: samples.filter(is_heartbeat() | (F.col("wait_event_type") == kind))
    return history.union_clusters({"east": kept("Lock"), "west": kept("IO").filter(is_heartbeat() | (F.col("pid") % 3 == 0))})


@query
def stop_clusters(spark, sf_dir):
    """Every cluster ends its own series; rankings divide by the samples it took."""
    samples = _two_series(spark, sf_dir)
    kept = series.stop_after_empty(samples, None, 2)
    busy = report.busy_by(kept, "wait_event_type AS wait", series.effective_iterations(samples, None, 2))
    return busy.select("cluster", "wait", "busy_pc", "distinct_exe").join(
        kept.groupBy("cluster").agg(F.count("*").alias("rows"), F.max("dtcol").alias("end_at")), "cluster"
    )


@query
def stop_clusters_planned(spark, sf_dir):
    planned = series.planned_instants(spark, SERIES_START, PLANNED, INTERVAL)
    samples = _two_series(spark, sf_dir)
    return series.effective_iterations(samples, planned, 2)


@query
def stream_stop(spark, sf_dir):
    """The series of each cluster ends inside the stream; two drops with a restart between them."""
    samples = _two_series(spark, sf_dir)
    folder, raw = new_folder(spark, "stop"), new_folder(spark, "raw")
    for part in (samples.filter(F.col("dtcol") < "2024-01-02 03:00:00"), samples.filter(F.col("dtcol") >= "2024-01-02 03:00:00")):
        part.write.mode("append").parquet(raw)
        stream = spark.readStream.schema(samples.schema).parquet(raw)
        kept = side_tables.snapshot_table(f"{folder}/samples", samples, at_stop=True)
        side_tables.stream_side_tables(stream, f"{folder}/ticks", f"{folder}/offsets", [kept], streak=2)
    return history.read_history(spark, f"{folder}/samples").select("cluster", "dtcol", "pid")


@query
def replay_after_compact(spark, sf_dir):
    """After each of two batches days are merged and the batch is repeated: nothing is added."""
    samples, table = _samples(spark, sf_dir), new_folder(spark, "history")
    middle = "2024-01-15 12:00:00"  # the second batch begins inside a day
    parts = [samples.filter(F.col("dtcol") < middle), samples.filter(F.col("dtcol") >= middle)]
    for number, part in enumerate(parts):
        write_batch(part, table, "sampler", number, INTERVAL)
        for day in history.partition_days(spark, table)[-2:]:
            history.compact(spark, table, day)
        write_batch(part, table, "sampler", number, INTERVAL)
    return _stored_rows(spark, table)


@query
def stream_over_midnight_compacted(spark, sf_dir):
    """The days before the second drop are merged before it arrives; memory goes on over midnight."""
    table, checkpoint = new_folder(spark, "history"), new_folder(spark, "offsets")
    for stream in _drops(spark, sf_dir, "raw"):
        collect_stream(stream, table, checkpoint, INTERVAL)
        for day in history.partition_days(spark, table)[-3:]:
            history.compact(spark, table, day)
    return _stored_rows(spark, table)


@query
def stream_memory(spark, sf_dir):
    """The collection with memory in keyed state, over two drops with a restart between them."""
    table, checkpoint = new_folder(spark, "history"), new_folder(spark, "offsets")
    for stream in _drops(spark, sf_dir, "raw"):
        collect_stream_state(stream, table, checkpoint, INTERVAL, locks=_session_locks(spark, sf_dir))
    return _stored_rows(spark, table)


# ---- several clusters with series of their own


def _shifted(spark, sf_dir, name, days, columns=()):
    """A fixture of two clusters; the west starts later and ends earlier than the east."""
    east = fixture(spark, sf_dir, name)
    span = east.agg(F.min("dtcol").alias("first"), F.max("dtcol").alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    inside = (F.col("dtcol") >= first + F.expr(f"interval {days} days")) & (F.col("dtcol") <= last - F.expr(f"interval {days} days"))
    west = east.filter(inside)
    for column in columns:
        west = west.withColumn(column, F.col(column) * 2)
    return history.union_clusters({"east": east, "west": west})


@query
def io_latency_clusters(spark, sf_dir):
    return counters.io_latency(_shifted(spark, sf_dir, "io_stats", 100, ("read_time", "evictions")))


@query
def same_reset_clusters(spark, sf_dir):
    return counters.unreset_pairs(_shifted(spark, sf_dir, "io_stats", 100))


@query
def inventory_clusters(spark, sf_dir):
    sizes = _shifted(spark, sf_dir, "database_sizes", 100)
    host = sizes.groupBy("cluster", "dtcol").agg(
        F.concat(F.lit("host-"), "cluster").alias("cluster_hostname"), F.lit("Linux").alias("cluster_os_family"),
        F.lit("16").alias("cluster_postgres_version"), F.count("*").cast("int").alias("cluster_processes"),
    )
    found = series.cluster_info(sizes, host, fixture(spark, sf_dir, "dated_settings"), every=10)
    return found.select("cluster", "dtcol", "cluster_hostname", "cluster_port", "cluster_pretty_size", "cluster_processes")


@query
def report_bounds_clusters(spark, sf_dir):
    samples = _shifted(spark, sf_dir, "session_samples", 2)
    hosts = report.report_host(_shifted(spark, sf_dir, "cluster_information", 2))
    return report.report_bounds(samples).join(report.host_cpu_avg(samples), "cluster").join(hosts, "cluster")


@query
def counter_steps(spark, sf_dir):
    """Growth of counters between snapshots, resets included; of two clusters with series of their own."""
    steps = counters.counter_steps(_shifted(spark, sf_dir, "io_stats", 100), ["reads", "read_time"], ["backend_type", "context"])
    return steps.select("cluster", "dtcol", "backend_type", "context", "reads_step", "read_time_step")


@query
def io_latency_across_resets(spark, sf_dir):
    return counters.io_latency_across_resets(_io(spark, sf_dir))


@query
def database_steps(spark, sf_dir):
    """Growth of a per-database counter that is stored at every sample."""
    path = new_folder(spark, "databases")
    history.append_samples(fixture(spark, sf_dir, "loop_sizes"), path)
    steps = counters.counter_steps(history.read_history(spark, path), ["size_bytes"], ["datname"], reset=None)
    return steps.select("dtcol", "datname", "size_bytes_step")


ROLLED = ["datname", "wait_event_type"]


@query
def busy_rollup(spark, sf_dir):
    """A window that begins and ends inside an hour, from hourly roll-ups made in two runs; some days are not rolled up."""
    samples = _samples(spark, sf_dir).withColumn("dtcol", F.col("dtcol") + F.expr("make_interval(0, 0, 0, 0, 0, 10 * coalesce(cast(pid % 6 as int), 0))"))
    table, path = new_folder(spark, "history"), new_folder(spark, "rollup")
    history.append_samples(samples, table)
    for day in (9, 17):
        rollup.update_rollup(spark, table, path, ROLLED, dt.date(2024, 1, day))
    start, end = (dt.datetime.fromisoformat(bound) + dt.timedelta(minutes=20) for bound in WINDOW)
    found = rollup.busy_rollup(rollup.window_rollup(spark, table, path, ROLLED, start, end), ROLLED, PLANNED)
    exact = report.distinct_executions(
        filters.window_scan(samples.filter("pid is not null"), start, end), ROLLED
    ).select(*[F.col(name).alias(f"of_{name}") for name in ROLLED], F.col("distinct_executions"))
    match = [F.col(name).eqNullSafe(F.col(f"of_{name}")) for name in ROLLED]
    close = F.abs(F.col("distinct_estimate") - F.col("distinct_executions")) <= 1 + 0.05 * F.col("distinct_executions")
    return found.join(exact, match).select(*ROLLED, "busy_pc", "executions", close.alias("close"), "non_cpu_pc", "mem", "swap")
