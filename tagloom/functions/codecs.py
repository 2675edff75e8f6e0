"""JSON in and out for dictionary rows and composed runs, with the accepted shapes as predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.schemas import ARRAY_FIELDS, COMPOSED, DICTIONARY, OPTIONAL_FIELDS


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def to_text(row: Column) -> Column:
    """A record as compact JSON; absent values are written as null."""
    return F.to_json(row, {"ignoreNullFields": "false"})


# kinds a JSON value may have for a column type; integers only, as in a column
_KINDS = {T.StringType: "^STRING$", T.BooleanType: "^BOOLEAN$", T.IntegerType: "^BIGINT$", T.ArrayType: "^ARRAY<"}


def _whole_elements(row: Column, field: T.StructField) -> Column:
    """No element of a list is null or lacks a member."""
    if isinstance(field.dataType.elementType, T.StructType):
        names = field.dataType.elementType.fieldNames()
        return F.forall(row[field.name], lambda e: _all([e[name].isNotNull() for name in names]))
    return F.forall(row[field.name], lambda e: e.isNotNull())


def _read(rows: DataFrame, value: str, schema: T.StructType, optional: list[str], shape: Column) -> DataFrame:
    """Add the struct ``row`` read from a JSON text, null where the text is not acceptable.

    Every member must be present and of the column's own kind (a number is no text); an optional one may
    be null; and ``shape`` must hold. The text is also parsed as a variant, which knows a missing member
    from a null one and a number from a text.
    """
    parts = F.struct(F.from_json(value, schema).alias("row"), F.try_parse_json(value).alias("members"))
    wide = rows.select("*", F.inline(F.array(parts)))  # a generator, so the text is parsed only here
    row, checks = F.col("row"), [shape]
    for field in schema:
        kind = F.schema_of_variant(F.try_variant_get("members", f"$.{field.name}", "variant"))
        typed = kind.rlike(_KINDS[type(field.dataType)]) & row[field.name].isNotNull()
        checks.append(typed | (kind == "VOID") if field.name in optional else typed)
        if isinstance(field.dataType, T.ArrayType):
            checks.append(_whole_elements(row, field))
    return wide.withColumn("row", F.when(F.coalesce(_all(checks), F.lit(False)), row)).drop("members")


def read_dictionary(rows: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to dictionary rows: ``started`` and ``traced`` must be both numbers or both null,
    ``disable_flag`` a boolean or null."""
    both = F.col("row.started").isNull() == F.col("row.traced").isNull()
    return _read(rows, value, DICTIONARY, OPTIONAL_FIELDS, both)


def read_composed(rows: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to composed runs: either all of started, traced, start_date and end_date, or none."""
    window = ["started", "traced", "start_date", "end_date"]
    n_set = reduce(lambda a, b: a + b, [F.col(f"row.{name}").isNotNull().cast("int") for name in window])
    return _read(rows, value, COMPOSED, window, n_set.isin(0, 4))


def is_complete(columns=DICTIONARY.fieldNames(), optional=OPTIONAL_FIELDS) -> Column:
    """Every mandatory column of a write payload is set."""
    return _all([F.col(name).isNotNull() for name in columns if name not in optional])


def stored_is_readable() -> Column:
    """What the store reader demands: all scalars but the optional ones; absent arrays are allowed."""
    return is_complete(optional=OPTIONAL_FIELDS + ARRAY_FIELDS)
