"""Input tables derived from the driver's tables, as SQL text.

The text is the common subset of Spark SQL and DuckDB: Spark runs it here, and
the oracle prefixes the very same text as CTEs. Every block reads whole tables.
``FIXTURES.md`` explains the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, tuple[str, str]] = {}


def _define(name: str, base: str, sql: str) -> None:
    FIXTURES[name] = (base, sql.strip())


_define("session_samples", "events", """
SELECT dtcol,
       CAST(16384 + user_id % 5 AS BIGINT) AS datid,
       concat('db', CAST(user_id % 5 AS STRING)) AS datname,
       CAST(1000 + user_id AS BIGINT) AS pid,
       CASE WHEN event_id % 6 = 0 THEN CAST(999 + user_id AS BIGINT) END AS leader_pid,
       concat('u', CAST(user_id % 7 AS STRING)) AS usename,
       concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(user_id % 250 AS STRING)) AS client_addr,
       CASE event_id % 5 WHEN 0 THEN 'psql'
            WHEN 1 THEN concat('prog,mod,act,info,', regexp_extract(props, '[0-9]+', 0), ',100')
            WHEN 2 THEN 'sampler' WHEN 3 THEN NULL ELSE 'web' END AS application_name,
       CASE event_id % 8 WHEN 0 THEN 'autovacuum worker' WHEN 1 THEN 'walsender'
            WHEN 2 THEN 'parallel worker' ELSE 'client backend' END AS backend_type,
       CASE WHEN event_id % 10 = 9 THEN 'idle' ELSE 'active' END AS state,
       CASE event_type WHEN 'click' THEN 'LWLock' WHEN 'view' THEN 'IO'
            WHEN 'error' THEN 'Lock' WHEN 'signup' THEN 'Activity' END AS wait_event_type,
       query_start,
       concat('SELECT  *  FROM ', event_type, ' WHERE k = ', regexp_extract(props, '[0-9]+', 0),
              ' AND s = ', chr(39), event_type, chr(39), ' AND v IN (1, ',
              regexp_extract(props, '[0-9]+', 0), ') LIMIT $', CAST(event_id % 3 + 1 AS STRING)) AS query,
       CASE WHEN event_id % 4 = 0 THEN CAST(100 + user_id % 9 AS BIGINT) END AS query_id,
       CAST(event_id % 101 AS DOUBLE) AS pourcentage_cpu,
       CAST(floor(value * 1048576) AS BIGINT) AS mem,
       CAST((event_id % 64) * 8192 AS BIGINT) AS swapped
FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol, user_id, min(event_id) AS event_id,
             min_by(event_type, event_id) AS event_type, min_by(props, event_id) AS props,
             CAST(date_trunc('minute', min(ts)) AS TIMESTAMP) AS query_start, max(value) AS value
      FROM {events} GROUP BY 1, 2) seen
UNION ALL
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP), CAST(NULL AS BIGINT), NULL, CAST(NULL AS BIGINT),
       CAST(NULL AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, CAST(NULL AS TIMESTAMP), NULL,
       CAST(NULL AS BIGINT), CAST(count(*) % 101 AS DOUBLE), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
FROM {events} GROUP BY 1
""")

_define("lock_snapshots", "lineitem", """
SELECT dtcol, locktype,
       CASE WHEN locktype IN ('relation', 'page', 'tuple') THEN database END AS database,
       CASE WHEN locktype IN ('relation', 'page', 'tuple') THEN parts END AS relation,
       CASE WHEN locktype IN ('page', 'tuple') THEN parts % 3 END AS page,
       CASE WHEN locktype = 'tuple' THEN parts % 2 END AS tuple,
       CASE WHEN locktype = 'virtualxid' THEN concat('9/', CAST(parts AS STRING)) END AS virtualxid,
       CASE WHEN locktype = 'transactionid' THEN 700000000 + parts END AS transactionid,
       CASE WHEN locktype = 'object' THEN CAST(1259 AS BIGINT) END AS classid,
       CASE WHEN locktype = 'object' THEN parts END AS objid,
       CASE WHEN locktype = 'object' THEN CAST(0 AS BIGINT) END AS objsubid,
       virtualtransaction, pid, granted
FROM (SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS dtcol,
             CASE l_partkey % 12 WHEN 0 THEN 'page' WHEN 1 THEN 'tuple' WHEN 2 THEN 'virtualxid'
                  WHEN 3 THEN 'transactionid' WHEN 4 THEN 'object' ELSE 'relation' END AS locktype,
             CASE WHEN l_linenumber % 2 = 0 THEN CAST(NULL AS BIGINT)
                  WHEN l_linestatus = 'O' THEN CAST(1 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS database,
             CAST(floor(l_partkey / 150) AS BIGINT) AS parts,
             concat('3/', CAST(l_suppkey AS STRING)) AS virtualtransaction,
             CASE WHEN l_suppkey % 10 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(l_suppkey / 3) AS BIGINT) END AS pid,
             l_linenumber < 3 AS granted
      FROM {lineitem}) l
UNION ALL
SELECT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP), 'transactionid', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRING), l_orderkey, CAST(NULL AS BIGINT),
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), concat('3/', CAST(l_suppkey AS STRING)), CAST(NULL AS BIGINT), true
FROM {lineitem} WHERE l_suppkey % 10 = 0
""")

_define("session_locks", "events", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol, 'relation' AS locktype,
       CAST(1 AS BIGINT) AS database, CAST(floor(user_id / 10) AS BIGINT) AS relation,
       CAST(NULL AS BIGINT) AS page, CAST(NULL AS BIGINT) AS tuple, CAST(NULL AS STRING) AS virtualxid,
       CAST(NULL AS BIGINT) AS transactionid,
       CAST(NULL AS BIGINT) AS classid, CAST(NULL AS BIGINT) AS objid, CAST(NULL AS BIGINT) AS objsubid,
       concat('4/', CAST(user_id AS STRING)) AS virtualtransaction,
       CAST(1000 + user_id AS BIGINT) AS pid, true AS granted
FROM {events}
UNION ALL
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP), 'relation',
       CAST(1 AS BIGINT), CAST(floor(user_id / 10) AS BIGINT) + 1,
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRING),
       CAST(NULL AS BIGINT),
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
       concat('4/', CAST(user_id AS STRING)),
       CAST(1000 + user_id AS BIGINT), false
FROM {events} WHERE event_type = 'error'
""")

_define("prepared_xacts", "orders", """
SELECT DISTINCT o_orderkey AS transaction_id, concat('gid-', CAST(o_orderkey AS STRING)) AS gid,
       CAST(o_orderdate AS TIMESTAMP) AS prepared, concat('u', CAST(o_custkey % 7 AS STRING)) AS owner,
       concat('db', CAST(o_custkey % 5 AS STRING)) AS database
FROM {orders}
""")

_define("prepared_snapshots", "lineitem", """
SELECT DISTINCT CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS dtcol, l_orderkey AS transaction_id,
       concat('gid-', CAST(l_orderkey AS STRING)) AS gid,
       CASE WHEN l_linestatus = 'O' THEN 'u1' ELSE 'u2' END AS owner
FROM {lineitem} WHERE l_suppkey % 10 = 0 AND l_returnflag <> 'R'
""")

_define("io_stats", "lineitem", """
SELECT dtcol, backend_type, context,
       CAST(tick * 1000 + q AS BIGINT) AS reads, CAST(tick * 3000 + q * 7 AS DOUBLE) AS read_time,
       CAST(tick * 500 + n AS BIGINT) AS writes, CAST(tick * 2000 + q AS DOUBLE) AS write_time,
       CAST(NULL AS BIGINT) AS writebacks, CAST(NULL AS DOUBLE) AS writeback_time,
       CAST(0 AS BIGINT) AS extends, CAST(0 AS DOUBLE) AS extend_time,
       CAST(tick * 300 + n AS BIGINT) AS fsyncs, CAST(tick * 1700 + q * 3 AS DOUBLE) AS fsync_time,
       CAST(tick * 30 + n * 3 AS BIGINT) AS evictions,
       CASE WHEN context = 'vacuum' AND dtcol >= CAST('1999-01-01' AS TIMESTAMP)
            THEN CAST('1999-01-01' AS TIMESTAMP) ELSE CAST('1995-01-01' AS TIMESTAMP) END AS stats_reset
FROM (SELECT dtcol, backend_type, context, CAST(sum(quantity) AS BIGINT) AS q, count(*) AS n,
             CAST(year(dtcol) * 12 + month(dtcol) AS BIGINT) AS tick
      FROM (SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS dtcol,
                   CASE l_linenumber % 2 WHEN 0 THEN 'checkpointer' ELSE 'client backend' END AS backend_type,
                   CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'R' THEN 'vacuum' ELSE 'bulkread' END AS context,
                   CAST(l_quantity AS BIGINT) AS quantity
            FROM {lineitem}) l
      GROUP BY 1, 2, 3) m
""")

_define("host_counters", "events", """
SELECT dtcol, CAST(tick * 1000 + n AS DOUBLE) AS user_s, CAST(tick * 2000 + n * 2 AS DOUBLE) AS system_s,
       CAST(tick * 7000 + n * 7 AS DOUBLE) AS idle_s, CAST(tick * 10 + n % 3 AS DOUBLE) AS iowait_s,
       CAST(17179869184 AS DOUBLE) AS mem_total, CAST(n % 101 AS DOUBLE) AS mem_percent,
       CAST(4294967296 AS DOUBLE) AS swap_total, CAST(n % 53 AS DOUBLE) AS swap_percent,
       CAST((tick * 10 + n) * 4096 AS DOUBLE) AS swap_in, CAST((tick * 10 + n) * 8192 AS DOUBLE) AS swap_out
FROM (SELECT dtcol, count(*) AS n,
             CAST((year(dtcol) * 372 + month(dtcol) * 31 + day(dtcol)) * 24 + hour(dtcol) AS BIGINT) AS tick
      FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol FROM {events}) e
      GROUP BY 1) h
""")

_define("host_times_text", "events", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol,
       concat('scputimes(user=', CAST(count(*) AS STRING), '.5, nice=0.0, system=',
              CAST(count(*) * 2 AS STRING), '.25, idle=', CAST(count(*) * 7 AS STRING), '.0)') AS raw
FROM {events} GROUP BY 1
""")

_define("database_sizes", "orders", """
SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS dtcol,
       concat('db', CAST(o_custkey % 5 AS STRING)) AS datname,
       CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS size_bytes,
       CASE WHEN min(o_custkey % 5) = 4 THEN true ELSE false END AS is_template
FROM {orders} GROUP BY 1, 2
""")

_define("cluster_information", "events", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS dtcol,
       concat('host', CAST(min(user_id) % 3 AS STRING)) AS cluster_hostname,
       'Linux' AS cluster_os_family, CAST(count(DISTINCT user_id) AS INT) AS cluster_processes
FROM {events} GROUP BY 1
""")

_define("settings", "orders", """
SELECT concat('setting_', CAST(o_orderkey AS STRING)) AS name,
       CASE o_orderkey % 5 WHEN 0 THEN '8kB' WHEN 1 THEN 'kB' WHEN 2 THEN '1MB' WHEN 3 THEN '16MB' ELSE '1GB' END AS unit,
       CAST(o_custkey AS STRING) AS setting
FROM {orders}
""")


_define("dated_settings", "orders", """
SELECT dtcol, 'shared_buffers' AS name, '8kB' AS unit, CAST(n AS STRING) AS setting FROM (
SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS dtcol, count(*) AS n FROM {orders} GROUP BY 1) b
UNION ALL
SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP), 'port', NULL, CAST(5432 + count(*) % 3 AS STRING)
FROM {orders} GROUP BY 1
UNION ALL
SELECT CAST(date_trunc('week', o_orderdate) AS TIMESTAMP), 'archive_mode', NULL,
       CASE WHEN count(*) % 2 = 0 THEN 'on' ELSE 'off' END
FROM {orders} GROUP BY 1
""")


_define("loop_io", "events", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol, event_type AS context,
       CAST(sum(user_id) AS BIGINT) AS reads, CAST(count(*) AS BIGINT) AS writes
FROM {events} GROUP BY 1, 2
""")

_define("loop_sizes", "events", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol, concat('db', CAST(user_id % 5 AS STRING)) AS datname,
       CAST(sum(user_id) * 100000 AS BIGINT) AS size_bytes, CASE WHEN min(user_id % 5) = 4 THEN true ELSE false END AS is_template
FROM {events} GROUP BY 1, 2
""")

_define("loop_locks", "events", """
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol, locktype, database, relation,
       CAST(NULL AS BIGINT) AS page, CAST(NULL AS BIGINT) AS tuple, CAST(NULL AS STRING) AS virtualxid, transactionid,
       CAST(NULL AS BIGINT) AS classid, CAST(NULL AS BIGINT) AS objid, CAST(NULL AS BIGINT) AS objsubid,
       virtualtransaction, pid, granted
FROM (SELECT ts, 'relation' AS locktype, CAST(1 AS BIGINT) AS database, CAST(user_id % 11 AS BIGINT) AS relation,
             CAST(NULL AS BIGINT) AS transactionid, concat('6/', CAST(user_id AS STRING)) AS virtualtransaction,
             CASE WHEN event_type = 'signup' THEN CAST(NULL AS BIGINT) ELSE CAST(1000 + user_id AS BIGINT) END AS pid,
             event_type <> 'error' AS granted
      FROM {events}
      UNION ALL
      SELECT ts, 'transactionid', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(900000 + user_id AS BIGINT),
             concat('6/', CAST(user_id AS STRING)), CAST(NULL AS BIGINT), true
      FROM {events} WHERE event_type = 'signup') l
""")

_define("loop_prepared", "events", """
SELECT DISTINCT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS dtcol, CAST(900000 + user_id AS BIGINT) AS transaction_id,
       concat('gid-', CAST(user_id AS STRING)) AS gid
FROM {events} WHERE event_type = 'signup' AND user_id % 3 <> 0
""")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of the operators, derived from the driver's tables."""
    base, sql = FIXTURES[name]
    return spark.sql(sql, **{base: table(spark, sf_dir, base)})


def fixture_cte(name: str) -> str:
    """``name AS (...)`` for the oracle's WITH list."""
    base, sql = FIXTURES[name]
    return f"{name} AS (\n{sql.replace('{' + base + '}', base)}\n)"
