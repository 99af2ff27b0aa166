"""Row numbers within groups of any size.

A window function puts a whole group into one task.  ``numbered`` range-
partitions the rows instead, numbers each partition's rows, and adds to them
how many rows of the group the partitions before hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dagloom.plans.fixpoint import cut

_ID, _PART, _LOW, _ROWS, _BEFORE = "__id", "__part", "__low", "__rows", "__before"
#: Bits of monotonically_increasing_id below the partition's number.
_WITHIN = 33


def windowed(df: DataFrame, group: list[str], order: list[Column | str], into: str) -> DataFrame:
    """df with the row's number from 0 within its group, by a window function."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn(into, rank.cast("long"))


def numbered(df: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """The same rows and numbers, with no task that holds a group.  Columns of
    order must tell the rows of a group apart; groups must not be null."""
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = cut(ranged.withColumn(_ID, F.monotonically_increasing_id())).withColumn(_PART, F.shiftright(_ID, _WITHIN))
    parts = placed.groupBy(*group, _PART).agg(F.min(_ID).alias(_LOW), F.count("*").alias(_ROWS))
    # a group has a row here for each partition that it reaches
    before = F.sum(_ROWS).over(Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*group, _PART, _LOW, F.coalesce(before, F.lit(0)).alias(_BEFORE))
    found = placed.join(parts, [*group, _PART])
    return found.select(*df.columns, (F.col(_BEFORE) + F.col(_ID) - F.col(_LOW)).cast("long").alias(into))


def ranked(df: DataFrame, group: list[str], order: list[str], into: str, task_rows: int) -> DataFrame:
    """The same by whichever form fits: windows unless a group has more than
    task_rows rows."""
    most = df.groupBy(*group).count().agg(F.max("count").alias("m")).first()["m"] or 0
    return windowed(df, group, order, into) if most <= task_rows else numbered(df, group, order, into)
