"""SQL texts that differ in their quoted values only: one template with a table of values.

The values of a template's texts become rows, and a lateral subquery asks the template of each row. Spark then joins
what the template reads with the rows, so the facts are read once for all texts of a template.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row

VALUE = "'[^']*'"
COMMENT = r"/\*[^'*]*\*/|--[^'\n]*(?:\n|$)"  # comments without quotes
#: where quotes may be of another kind: other comments, other quotes, escapes, doubled quotes, letters next to a quote
UNCLEAR = r"--|/\*|[\"`\\]|''|\w'|'\w"
DATE = re.compile(r"\bdate\s*$", re.IGNORECASE)
VALUES = "tagloom_values"


def pieces(sql: Column) -> Column:
    """What stands around the quoted values; a text whose quotes are not plain is one piece."""
    outside = F.regexp_replace(F.regexp_replace(sql, VALUE, "' '"), COMMENT, " ")
    return F.when(F.regexp_like(outside, F.lit(UNCLEAR)) | F.contains(sql, F.lit("\\")), F.array(sql)).otherwise(
        F.split(sql, VALUE, -1))


def values(sql: Column) -> Column:
    """The quoted values of a text with several pieces, in order."""
    return F.when(F.size(pieces(sql)) > 1, F.regexp_extract_all(sql, F.lit("'([^']*)'"), F.lit(1))).otherwise(
        F.array().cast("array<string>"))


def template_id(sql: Column) -> Column:
    return F.sha2(F.to_json(pieces(sql)), 256)


def one_text(run: Row) -> str:
    return run["pieces"][0] + "".join(f"'{value}'{piece}" for value, piece in zip(run["values"], run["pieces"][1:]))


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def together(spark: SparkSession, runs: Sequence[Row], names: Sequence[str], output: str) -> DataFrame:
    """``names`` of the runs and ``output`` of their texts, for runs of one template with values.

    The rows of values are part of the text, so Spark knows that they are few and joins the facts with a broadcast of
    them. Values prune no partitions of the facts any more. Raises what Spark raises where a value stands in a
    place that a column cannot take.
    """
    columns = [*names, *(f"v{i}" for i in range(len(runs[0]["values"])))]
    rows = ", ".join("(" + ", ".join(map(_quoted, [*(run[c] for c in names), *run["values"]])) + ")" for run in runs)
    first, *others = runs[0]["pieces"]
    asked = first
    for i, piece in enumerate(others):
        value, typed = f"{VALUES}.v{i}", DATE.search(asked)
        asked = (f"{asked[:typed.start()]}CAST({value} AS DATE)" if typed else asked + value) + piece
    kept = ", ".join(f"{VALUES}.{c}" for c in names)
    frame = spark.sql(f"SELECT {kept}, {output} FROM VALUES {rows} AS {VALUES}({', '.join(columns)}), LATERAL ({asked}\n)")
    if _fixed_length(frame):
        raise ValueError("a CHAR column pads the literals it is compared with, and no values")
    return frame


def _fixed_length(frame: DataFrame) -> bool:
    """Whether the plan pads columns of type CHAR."""
    return "readSidePadding" in frame._jdf.queryExecution().optimizedPlan().toJSON()
