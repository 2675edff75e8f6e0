"""The main path as a whole."""

from pyspark.sql import functions as F

from tagloom.functions import calendar as cal
from tagloom.plans.status_flow import ready_cycles, tag_status_flow
from tests.conftest import rows


def test_of_several_definitions_the_first_counts(inputs):
    twice = inputs.dictionary.unionByName(inputs.dictionary.withColumn("row_seq", F.col("row_seq") + 10**6).withColumn(
        "sql", F.lit("select 1 from VP_BANK.v_1")))
    once = tag_status_flow(inputs.mapping, inputs.dictionary, inputs.frontier)
    both = tag_status_flow(inputs.mapping, twice, inputs.frontier)
    assert rows(both) == rows(once)


def test_monthly_tags_run_once_per_target_month(inputs):
    ready = ready_cycles(inputs.mapping, inputs.dictionary, inputs.frontier)
    again = ready.filter("update_frequency = 'M'").groupBy("tag_id", "target_month").count().filter("count > 1")
    assert again.count() == 0
    loose = ready_cycles(inputs.mapping, inputs.dictionary, inputs.frontier, guard=False)
    assert loose.count() > ready.count()


def test_messages_in_any_order_and_repeated_give_the_same(inputs):
    shuffled = inputs.frontier.unionByName(inputs.frontier).orderBy(F.xxhash64("event_id"))
    assert rows(ready_cycles(inputs.mapping, inputs.dictionary, shuffled)) == rows(
        ready_cycles(inputs.mapping, inputs.dictionary, inputs.frontier))


def test_a_literal_cutoff_changes_the_cycles(inputs):
    early = ready_cycles(inputs.mapping, inputs.dictionary, inputs.frontier, cal.Schedule(cutoff="12:07:00"))
    assert rows(early, "tag_id", "cycle") != rows(ready_cycles(inputs.mapping, inputs.dictionary, inputs.frontier), "tag_id", "cycle")
