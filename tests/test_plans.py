"""What the plans must look like: nothing row by row in Python, no product of tables, filters at the scan."""

import pytest

from tests.conftest import SMALL
from workload import fixtures as fx
from workload.queries import REGISTRY

PYTHON_ALLOWED = {"readiness_rounds", "readiness_stream", "status_stream", "transition_log"}
EAGER = {"frontier_source", "composed_run_sink", "start_message_sink", "finish_message_sink", "run_ready_tags", "run_ready_tags_report"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - PYTHON_ALLOWED - EAGER))
def test_stateless_operators_stay_in_the_jvm(spark, name):
    text = plan(REGISTRY[name](spark, SMALL))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text, name


def test_flagship_reads_each_big_table_once(spark):
    text = plan(REGISTRY["tag_status_flow"](spark, SMALL))
    assert "props" not in text and "user_id" not in text  # only the columns in use are read
    frame = REGISTRY["tag_status_flow"](spark, SMALL)
    frame.collect()
    final = plan(frame).split("\n+- == Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan" in line]
    assert sum("event_id" in s for s in scans) == 1
    assert sum("p_partkey" in s for s in scans) == 1


def test_filters_reach_the_scan(spark):
    from tagloom.operators import dictionary as td
    from tagloom.session import fresh_dir
    from tagloom.sources import tables
    path = fresh_dir(spark, "dictionary")
    fx.stored_dictionary(spark, SMALL).write.parquet(path)
    found = td.search(tables.read_dictionary(spark, path), system_name="ATS", started=-2).select("tag_id")
    text = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(system_name,ATS)" in text and "EqualTo(started,-2)" in text
