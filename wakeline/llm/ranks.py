"""Gapless numbers within groups, by range partitions and built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.text import stored

# Documented layout of monotonically_increasing_id: the partition above, the row in it below.
ROW_BITS = 33


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of ``df`` in any case of letters."""
    taken, found = {name.lower() for name in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def ranked(rows: DataFrame, group: str, order: list[Column], number: str, count: str) -> DataFrame:
    """Add a number from 0 within each value of ``group``, by ``order``, and the group's size.

    ``group`` has no nulls; rows of equal order keep all their numbers, in any order among them.
    Rows are range-partitioned by group and order, so neither a large group nor many ties meet in
    one task. Each task's rows are numbered as they are written; what is summed up over tasks has
    a row for each group and task. ``rows`` is read twice, once to find the ranges.
    """
    tie, place, task, first, size, start = free_names(rows, "tie", "place", "task", "first", "size", "start")
    keys = [F.col(group), *order, F.col(tie)]
    spread = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(spread.drop(tie).withColumn(place, F.monotonically_increasing_id()), "ranked")
    of_task = F.shiftright(F.col(place), ROW_BITS)
    sizes = placed.groupBy(group, of_task.alias(task)).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(group).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        group,
        task,
        first,
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start),
        F.sum(size).over(Window.partitionBy(group)).alias(count),
    )
    joined = placed.withColumn(task, of_task).join(starts, [group, task])
    return joined.withColumn(number, F.col(start) + F.col(place) - F.col(first)).select(*rows.columns, number, count)
