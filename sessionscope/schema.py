"""Names and types shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTANT = "dtcol"

# The ten columns that identify a lockable object.
LOCK_IDENTITY = (
    "locktype", "database", "relation", "page", "tuple",
    "virtualxid", "transactionid", "classid", "objid", "objsubid",
)

# Inventory row of one cluster at one instant.
CLUSTER_INFORMATION = T.StructType([
    T.StructField("dtcol", T.TimestampType()),
    T.StructField("cluster_hostname", T.StringType()),
    T.StructField("cluster_os_family", T.StringType()),
    T.StructField("cluster_postgres_version", T.StringType()),
    T.StructField("cluster_port", T.StringType()),
    T.StructField("cluster_archive_mode", T.StringType()),
    T.StructField("cluster_size", T.LongType()),
    T.StructField("cluster_pretty_size", T.StringType()),
    T.StructField("cluster_shared_buffers", T.StringType()),
    T.StructField("cluster_processes", T.IntegerType()),
    T.StructField("cluster_databases", T.StringType()),
    T.StructField("cluster_comment", T.StringType()),
])

# Columns the enrichment adds to an activity sample, in storage order.
DERIVED_COLUMNS = T.StructType([
    T.StructField("iquery", T.LongType()),
    T.StructField("tquery", T.StringType()),
    T.StructField("itquery", T.LongType()),
    T.StructField("dquery", T.ArrayType(T.StringType())),
    T.StructField("blockers", T.ArrayType(T.LongType())),
    T.StructField("pourcentage_cpu", T.DoubleType()),
    T.StructField("mem", T.LongType()),
    T.StructField("swapped", T.LongType()),
    T.StructField("application_info", T.MapType(T.StringType(), T.StringType())),
])


def keys_of(rows: DataFrame, *names: str) -> list[str]:
    """Key columns: the cluster, where the rows are of several, and then the names."""
    return [*(["cluster"] if "cluster" in rows.columns else []), *names]


def is_heartbeat() -> Column:
    """The one row per sample that stands for the host, not for a session."""
    return F.col("datid").isNull() & F.col("pid").isNull()


def is_host_row() -> Column:
    """Rows carrying whole-host CPU."""
    return F.col("pid").isNull()


def is_session() -> Column:
    """Session rows as the batch report counts them."""
    return F.col("pid").isNotNull() | F.col("datid").isNotNull()


def is_process() -> Column:
    """Session rows as the interactive ranking counts them."""
    return F.col("pid").isNotNull()
