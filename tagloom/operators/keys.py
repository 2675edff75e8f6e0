"""Joins on the message key, and joins that stay even when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.schemas import KEY
from tagloom.session import stable

SIDE = 1_000  # rows of each side that a slice of a key combines, when both sides have more
PAIRS = SIDE * SIDE  # rows that a slice of a key makes


def key_join(left: DataFrame, right: DataFrame, how: str = "inner", keys: list[str] = KEY) -> DataFrame:
    """Join on the key, keeping one copy of the key columns."""
    other = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(other, condition, how).drop(*[f"_r_{c}" for c in keys])


def _share(own: Column, partners: Column, side: int) -> Column:
    """Slices of one side: so many that a slice makes ``side`` squared rows at most, with few repeated rows."""
    pairs = side * side
    return (
        F.when(partners <= side, F.ceil(own * partners / pairs)).when(own <= side, F.lit(1)).otherwise(F.ceil(own / side))
    ).cast("int")


def key_slices(left: DataFrame, right: DataFrame, keys: list[str], left_rows: int | None = None,
               right_rows: int | None = None, side: int = SIDE) -> DataFrame:
    """(key, _left, _right) for every key whose product has to be cut: slices of either side.

    Counted on both sides by partial aggregates and met by key, whatever the number of such keys. A side that
    is not worth a pass, or a stream, gives the rows that a key has at most or commonly instead: that only
    shapes the slices.
    """
    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    if left_rows is not None:
        sizes = counted(right, "_nr").withColumn("_nl", F.lit(left_rows))
    elif right_rows is not None:
        sizes = counted(left, "_nl").withColumn("_nr", F.lit(right_rows))
    else:
        sizes = key_join(counted(left, "_nl"), counted(right, "_nr"), "inner", keys)
    cut = sizes.select(*keys, _share(F.col("_nl"), F.col("_nr"), side).alias("_left"),
                       _share(F.col("_nr"), F.col("_nl"), side).alias("_right"))
    return cut.filter("_left * _right > 1")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], spread_left: list[str], spread_right: list[str],
               left_rows: int | None = None, right_rows: int | None = None, expands: bool = False,
               side: int = SIDE) -> DataFrame:
    """Inner equi-join for a many-to-many match, where both sides may have many rows of one key.

    A join task that gets a key with very many bytes is split by Spark itself at run time. What Spark does not
    see is a key whose rows are few bytes but whose product is huge. So every key whose product is over
    ``side`` squared is dealt out on a grid: its left rows by a hash of ``spread_left`` and its right rows by a
    hash of ``spread_right``, each repeated along the other edge of the grid. Results equal the plain join.

    ``left_rows`` or ``right_rows`` stand for the count of a side (see ``key_slices``); a stream needs
    ``left_rows``, the most that a micro-batch brings. ``expands`` is for products much bigger than their inputs:
    it fixes the number of partitions, which Spark would otherwise shrink to fit the small input.
    """
    cut = key_slices(left, right, keys, left_rows, right_rows, side)
    if left.isStreaming:
        cut = stable(cut, "slices")  # a written table has a known size, from which a stream's plan is chosen
    number, copies = F.coalesce(F.col("_left"), F.lit(1)), F.coalesce(F.col("_right"), F.lit(1))

    def dealt(rows: DataFrame, spread: list[str], own: Column, other: Column, at: str, along: str) -> DataFrame:
        return key_join(rows, cut, "left", keys).withColumn(at, F.pmod(F.xxhash64(*spread), own).cast("int")).withColumn(
            along, F.explode(F.sequence(F.lit(0), other - 1))).drop("_left", "_right")

    a = dealt(left, spread_left, number, copies, "_i", "_j")
    b = dealt(right, spread_right, copies, number, "_j", "_i")
    if expands:
        a = a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_i", "_j")
    return key_join(a, b, "inner", [*keys, "_i", "_j"]).drop("_i", "_j")
