"""Record schemas and the fixed values of the message and dictionary formats."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must equal the formats in use; do not edit) ----
SYSTEM_NAME = "ATS"
FRONTIER_TOPICS = ("frontier-adw",)
START_TOPIC = "hippo-start"
FINISH_TOPIC = "hippo-finish"
PRODUCER_NAME = "batchetl.tagging"
PRODUCER_KEY = "tagKey"
VIEW_REFERENCE = "(VP_BANK|vp_bank)[.]([a-z_A-Z0-9-]+)"
INDICATOR_ON = "v"
MONTH_PARTITION = "yyyymm"
START_MARK = "$start_date"
END_MARK = "$end_date"
ATTEMPTS = 3
DEBOUNCE_SECONDS = 20
# -------------------------------------------------------------------

DAILY, MONTHLY = "D", "M"
WAITING, RECEIVING, RUNNING, VERIFYING = "Waiting", "Receiving", "Running", "Verifying"
START, FINISH, NON_FINISH = "Start", "Finish", "NonFinish"

KEY = ["freq", "dbt", "part"]  # identity of a table message; part may be null

TAG_TYPE = T.ArrayType(
    T.StructType([T.StructField("type_L1", T.StringType()), T.StructField("type_L2", T.StringType())])
)

DICTIONARY = T.StructType([
    T.StructField("tag_id", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_item", T.StringType()),
    T.StructField("tag_type", TAG_TYPE),
    T.StructField("tag_name", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("update_frequency", T.StringType()),
    T.StructField("started", T.IntegerType()),
    T.StructField("traced", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("create_time", T.StringType()),
    T.StructField("update_time", T.StringType()),
    T.StructField("disable_flag", T.BooleanType()),
    T.StructField("score_method", T.StringType()),
    T.StructField("attribute", T.StringType()),
    T.StructField("creator", T.StringType()),
    T.StructField("is_focus", T.BooleanType()),
    T.StructField("system_name", T.StringType()),
    T.StructField("tickets", T.ArrayType(T.StringType())),
])
DICTIONARY_FIELDS = DICTIONARY.fieldNames()
OPTIONAL_FIELDS = ["started", "traced", "disable_flag"]
ARRAY_FIELDS = ["tag_type", "tickets"]
SEARCH_FIELDS = ["source_type", "source_item", "tag_type", "tag_name", "update_frequency", "started", "traced",
                 "score_method", "attribute", "system_name"]

COMPOSED = T.StructType(
    [DICTIONARY[name] for name in DICTIONARY_FIELDS[:9]]
    + [DICTIONARY["score_method"], DICTIONARY["attribute"]]
    + [T.StructField(name, T.StringType()) for name in ("start_date", "end_date", "execute_date")]
    + [DICTIONARY["system_name"]]
)
COMPOSED_FIELDS = COMPOSED.fieldNames()

FRONTIER = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("partition_fields", T.ArrayType(T.StringType())),
    T.StructField("partition_values", T.ArrayType(T.StringType())),
    T.StructField("db", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("exec_date", T.LongType()),
])

NEED_MESSAGE = T.StructType([
    T.StructField("update_frequency", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition_fields", T.StringType()),
])

START_MESSAGE = T.StructType([
    T.StructField("hippo_name", T.StringType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("need_msgs", T.ArrayType(NEED_MESSAGE)),
    T.StructField("start_time", T.LongType()),
])

RECEIVED_MESSAGE = T.StructType([
    T.StructField("kafkaTopic", T.StringType()),
    T.StructField("update_frequency", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition_fields", T.StringType()),
    T.StructField("partition_values", T.StringType()),
    T.StructField("finish_time", T.LongType()),
])

FINISH_MESSAGE = T.StructType([
    T.StructField("hippo_name", T.StringType()),
    T.StructField("job_name", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("update_frequency", T.StringType()),
    T.StructField("execute_time", T.StringType()),
    T.StructField("duration_time", T.LongType()),
    T.StructField("finish_time", T.LongType()),
    T.StructField("is_success", T.BooleanType()),
    T.StructField("receive_msgs", T.ArrayType(RECEIVED_MESSAGE)),
])

MAPPING = T.StructType(
    [T.StructField("row_seq", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in (
        "view_id", "db_id", "table_id", "year_ind", "month_ind", "day_ind", "ref_ind", "partition_id",
        "disabled_ind")]
)
