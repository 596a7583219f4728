"""The shared folder and the flow of a small job from samples to report."""

import pytest
from pyspark.sql import functions as F

from sessionscope import session
from sessionscope.catalog import queries as Q
from sessionscope.operators import locks
from sessionscope.plans.collect import collect
from sessionscope.plans.report import build_report
from sessionscope.schema import DERIVED_COLUMNS
from sessionscope.sources.history import append_samples, read_history

SF_DIR = "/root/testdata/sf0.001"


def test_intermediate_tables_go_to_the_configured_folder(spark):
    frame = session.materialize(spark.range(5), "five")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in name for name in frame.inputFiles())
    assert sorted(row.id for row in frame.collect()) == [0, 1, 2, 3, 4]


class Cluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default

    class sparkContext:
        master = "yarn"


def test_a_cluster_has_to_name_its_folder():
    with pytest.raises(ValueError):
        session.shared_folder(Cluster)


def test_collect_store_report(spark, tmp_path):
    rows = collect(
        Q._samples(spark, SF_DIR),
        Q._session_locks(spark, SF_DIR),
        Q._cpu_probes(spark, SF_DIR),
        Q._memory_probes(spark, SF_DIR),
        Q.INTERVAL,
        text_search=True,
        folder=str(tmp_path),
    )
    assert set(DERIVED_COLUMNS.names) <= set(rows.columns)
    path = session.new_folder(spark, "history")
    append_samples(rows, path, lookup=("iquery",))
    history = read_history(spark, path)
    assert history.count() == rows.count()
    assert history.filter(F.size("blockers") > 0).count() > 0
    sections = build_report(
        history, Q._cluster(spark, SF_DIR), Q._host(spark, SF_DIR), Q._io(spark, SF_DIR), *Q.WINDOW, n=3
    )
    assert sections["top_queries"].count() == 3
    assert sections["activity"].first().elapsed > 0
    scanned = sections["activity"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scanned


def test_batch_collection_probes_small_loads_afresh(spark, tmp_path):
    """With few sessions a cached value is rarely used, so nearly every row keeps its own probe."""
    probes = Q._memory_probes(spark, SF_DIR)
    rows = [
        collect(Q._samples(spark, SF_DIR), Q._session_locks(spark, SF_DIR), Q._cpu_probes(spark, SF_DIR),
                probes, Q.INTERVAL, batch=batch, folder=str(tmp_path)).filter("pid is not null")
        for batch in (False, True)
    ]
    own = [
        row.join(probes.withColumnsRenamed({"mem": "probed"}).drop("swapped"), ["dtcol", "pid"])
        .filter("mem <> probed").count()
        for row in rows
    ]
    assert rows[0].count() == rows[1].count()
    assert own[1] <= own[0] and own[0] > 0


def test_lock_joins_have_no_cross_product(spark, tmp_path):
    plan = locks.final_blockers(Q._object_locks(spark, SF_DIR), folder=str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
