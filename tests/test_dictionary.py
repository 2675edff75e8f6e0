import json

import pytest
from pyspark.sql import types as T

from tagloom.functions import codecs
from tagloom.operators import dependencies as dp
from tagloom.operators import dictionary as td
from tagloom.schemas import DICTIONARY
from tagloom.session import fresh_dir
from tagloom.sources import tables
from tests.conftest import rows

STORED = T.StructType([T.StructField("row_seq", T.LongType()), *DICTIONARY.fields])
FEED = T.StructType([*STORED.fields, T.StructField("target_id", T.StringType())])


def row(seq, tag, sql="select 1", system="ATS", attribute="a", freq="D", tag_type=(("x", "y"),)):
    types = None if tag_type is None else [list(t) for t in tag_type]
    return (seq, tag, "s", "i", types, "n", sql, freq, None, None, "d", "c", "u", True, "sum", attribute, "w", False, system, None)


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame([row(1, "a"), row(2, "b"), row(3, "a", "second"), row(4, "c", tag_type=None)], STORED)


def feed(spark, *changes):
    return spark.createDataFrame([row(*c[:-1]) + (c[-1],) for c in changes], FEED)


def test_replace_touches_only_the_first_row_of_an_id(spark, stored):
    changes = feed(spark, (10, "a", "old", "a"), (11, "a", "new", "a"), (12, "z", "none", "zz"))
    assert rows(td.replace(stored, changes), "row_seq", "tag_id", "sql") == [
        (1, "a", "new"), (2, "b", "select 1"), (3, "a", "second"), (4, "c", "select 1")]


def test_replace_puts_the_whole_payload(spark, stored):
    changes = feed(spark, (10, "renamed", "new", None, None, "b"))
    assert rows(td.replace(stored, changes), "row_seq", "tag_id", "system_name", "attribute")[1] == (2, "renamed", None, None)


def test_upsert_appends_what_is_not_there(spark, stored):
    table, changed = td.upsert(stored, feed(spark, (10, "b", "new", "b"), (11, "z", "fresh", "z")))
    assert rows(changed, "row_seq", "tag_id", "sql") == [(11, "z", "fresh"), (2, "b", "new")]
    assert rows(table, "tag_id", "sql") == [("a", "second"), ("a", "select 1"), ("b", "new"), ("c", "select 1"), ("z", "fresh")]


def test_remove_drops_all_rows_and_names_missing_ids(spark, stored):
    ids = spark.createDataFrame([("a",), ("nope",)], "tag_id string")
    assert rows(td.remove(stored, ids), "tag_id") == [("b",), ("c",)]
    assert rows(td.missing_ids(stored, ids)) == [("nope",)]


def test_get_and_search(spark, stored):
    assert td.get_one(stored, "a")["row_seq"] == 1
    with pytest.raises(LookupError):
        td.get_one(stored, "nope")
    assert rows(td.search(stored, tag_type=[("x", "y")], system_name="ATS"), "row_seq") == [(1,), (2,), (3,)]
    assert td.search(stored, tag_type=[]).count() == 1  # an absent list reads as empty
    assert td.search(stored).count() == 4
    assert td.search(stored, started=None).count() == 4  # fields not set do not filter
    with pytest.raises(ValueError):
        td.search(stored, tag_id="a")


def test_system_name_in_any_case(spark):
    payloads = feed(spark, (1, "a", "q", "ats", "a"), (2, "b", "q", None, "b"), (3, "c", "q", "CRM", "c"), (4, "d", "q", "Ats", "d"))
    assert rows(td.of_system(payloads), "tag_id") == [("a",), ("d",)]


GOOD = dict(tag_id="a", source_type="s", source_item="i", tag_type=[{"type_L1": "x", "type_L2": "y"}], tag_name="n", sql="q",
            update_frequency="D", started=-1, traced=1, description="d", create_time="c", update_time="u", disable_flag=False,
            score_method="sum", attribute="a", creator="w", is_focus=True, system_name="ATS", tickets=["t"])


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


@pytest.mark.parametrize("value,accepted", [
    (GOOD, True), (GOOD | {"started": None, "traced": None}, True), (GOOD | {"disable_flag": None}, True),
    (GOOD | {"started": None}, False), (GOOD | {"traced": None}, False), (without("disable_flag"), False),
    (without("started"), False), (without("sql"), False), (GOOD | {"sql": None}, False), (GOOD | {"tickets": None}, False),
    (GOOD | {"tag_id": 5}, False), (GOOD | {"sql": ["q"]}, False), (GOOD | {"started": "-1"}, False), (GOOD | {"tickets": "t"}, False),
    (GOOD | {"tickets": ["t", None]}, False), (GOOD | {"tag_type": [{"type_L1": "x"}]}, False), (GOOD | {"tag_type": []}, True),
    (GOOD | {"disable_flag": 1}, False), (GOOD | {"is_focus": "yes"}, False), (GOOD | {"started": "x"}, False), (GOOD | {"extra": 1}, True), (GOOD | {"tickets": []}, True),
])
def test_dictionary_json_shapes(spark, value, accepted):
    frame = spark.createDataFrame([(json.dumps(value),)], "value string")
    read = codecs.read_dictionary(frame).first()["row"]
    assert (read is not None) == accepted
    if accepted:
        assert read["tag_id"] == "a" and read["started"] == value["started"]


def test_not_json_is_refused(spark):
    frame = spark.createDataFrame([("nope",), (None,), ("[]",)], "value string")
    assert [r["row"] for r in codecs.read_dictionary(frame).collect()] == [None] * 3


def test_composed_json_does_not_round_trip_without_dates(spark):
    base = {k: GOOD[k] for k in ("tag_id", "source_type", "source_item", "tag_type", "tag_name", "sql", "update_frequency",
                                 "score_method", "attribute", "system_name")} | {"execute_date": "2018-09-22"}
    shapes = [((-1, 1, "a", "b"), True), ((None,) * 4, True), ((-1, 1, None, None), False), ((-1, None, "a", "b"), False)]
    for values, accepted in shapes:
        text = json.dumps(base | dict(zip(("started", "traced", "start_date", "end_date"), values)))
        frame = spark.createDataFrame([(text,)], "value string")
        assert (codecs.read_composed(frame).first()["row"] is not None) == accepted


def test_second_load_of_an_id_is_ignored(spark):
    views = spark.createDataFrame([("v", "D", "d.v", None), ("w", "D", "d.w", None)], "view string, freq string, dbt string, part string")
    batch = spark.createDataFrame([row(1, "a", "VP_BANK.v", freq="d"), row(2, "a", "VP_BANK.w")], STORED)
    none = spark.createDataFrame([], "tag_id string, update_frequency string, freq string, dbt string, part string")
    empty = none.select("tag_id")
    assert rows(dp.add(none, empty, batch, views)) == [("a", "D", "D", "d.v", None)]
    assert rows(dp.register(batch)) == [("a", "D")]


def test_references(spark):
    views = spark.createDataFrame([("v", "D", "d.t", None), ("w", "D", "d.t", None), ("x-y_1", "M", "d.x", "yyyymm")],
                                  "view string, freq string, dbt string, part string")
    sql = "select 1 from VP_BANK.v, vp_bank.w, Vp_bank.v, OLDVP_BANK.x-y_1 -- VP_BANK.gone, VP_BANK.V"
    batch = spark.createDataFrame([row(1, "a", sql)], STORED)
    assert rows(dp.resolve(batch, views), "freq", "dbt", "part") == [("D", "d.t", None), ("M", "d.x", "yyyymm")]
    assert rows(dp.unresolved(batch, views), "view") == [("V",), ("gone",)]


def test_versions_and_formats(spark, stored):
    base = fresh_dir(spark, "dictionary")
    tables.save_version(stored, base, 1)
    tables.save_version(td.remove(tables.load_version(spark, base), stored.filter("tag_id = 'a'")), base, 2)
    assert tables.load_version(spark, base).count() == 2 and tables.load_version(spark, base, 1).count() == 4
    for fmt in ("json", "orc", "parquet"):
        path = fresh_dir(spark, fmt)
        stored.write.format(fmt).save(path)
        assert rows(td.scan(tables.read_dictionary(spark, path, fmt)), "row_seq", "tag_id", "tickets") == rows(
            td.scan(stored), "row_seq", "tag_id", "tickets")


def test_mapping_formats(spark, inputs):
    for fmt, options in (("csv", {"emptyValue": ""}), ("csv", {}), ("json", {}), ("parquet", {})):
        path = fresh_dir(spark, fmt)
        inputs.mapping.write.format(fmt).options(**options).save(path)
        assert rows(tables.read_mapping(spark, path, fmt, **options)) == rows(inputs.mapping)
