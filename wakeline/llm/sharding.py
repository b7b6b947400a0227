"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ``-ln(u) / weight`` with ``u`` a hash of the key and the
child's name; the smallest draw wins, and the descent goes on below it. A child's weight is
the sum of the weights below, so a change of one shard's weight changes the weights on its
own path only: rows move into or out of those subtrees and nowhere else. A shard that is
opened in a region of its own is the only subtree with a new weight, so it is the only one
that takes rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.ranks import free_names
from wakeline.llm.text import stored

# region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def tree_of(shards: int, base: int = 8, racks: int = 2, per_rack: int = 2) -> Tree:
    """The first ``base`` shards in regions of ``racks`` times ``per_rack``; each later one in a region of its own."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        region, name = (f"r{rack // racks}", f"k{rack}") if shard < base else (f"x{shard}", f"x{shard}")
        tree.setdefault(region, {}).setdefault(name, {})[shard] = 1.0
    return tree


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate ``weight``, fixed by key and name."""
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}/"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((hashed + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(weight)


def winner(key: Column, weights: dict, level: str) -> Column:
    """The child with the smallest draw; a child of weight 0 has none."""
    drawn = [
        F.struct(draw(key, f"{level}:{child}", weight).alias("draw"), F.lit(child).alias("child"))
        for child, weight in weights.items()
        if weight > 0
    ]
    return F.least(*drawn)["child"] if len(drawn) > 1 else drawn[0]["child"]


def placed(key: Column, tree: Tree) -> Column:
    """The struct of region, rack and shard that a key descends to."""

    def below(level: Column, choices: dict) -> Column:
        chosen = None
        for name, value in choices.items():
            chosen = F.when(level == F.lit(name), value) if chosen is None else chosen.when(level == F.lit(name), value)
        return chosen

    rack_weights = {rack: sum(shards.values()) for racks in tree.values() for rack, shards in racks.items()}
    region = winner(key, {name: sum(rack_weights[rack] for rack in racks) for name, racks in tree.items()}, "region")
    rack = below(
        region,
        {
            name: winner(key, {rack: rack_weights[rack] for rack in racks}, "rack")
            for name, racks in tree.items()
            if any(rack_weights[rack] > 0 for rack in racks)
        },
    )
    shard = below(
        rack,
        {
            name: winner(key, shards, "shard")
            for racks in tree.values()
            for name, shards in racks.items()
            if rack_weights[name] > 0
        },
    )
    return F.struct(region.alias("region"), rack.alias("rack"), shard.cast("int").alias("shard"))


def key_of(column: Column) -> Column:
    """Keys as text; a null key is one key of its own."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def numbered(rows: DataFrame, group: str, order: list[str], number: str) -> DataFrame:
    """Add a gapless number from 0 within each value of ``group``, in the order of ``order``.

    Rows are range-partitioned by ``order``, so no group meets in one task; ties go to several
    tasks too. Each task numbers its own rows of each group, the result is written, and the
    counts of tasks and groups, summed up, are what the tasks' numbers start from. A column of the
    name ``number`` is replaced.
    """
    rows = rows.drop(number)
    columns, schema = rows.columns, rows.schema
    tie_, own_, task_, rows_, start_, group_, from_ = free_names(rows, "_tie", "_own", "_task", "_rows", "_start", "_group", "_from")
    spread = rows.withColumn(tie_, F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*order, tie_).sortWithinPartitions(*order, tie_).drop(tie_)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            own = batch.groupby(group, dropna=False).cumcount()
            batch[own_] = own + batch[group].map(lambda key: seen.get(key, 0)).astype("int64")
            for key, rows in batch[group].value_counts(dropna=False).items():
                seen[key] = seen.get(key, 0) + int(rows)
            batch[task_] = task
            yield batch

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    own = stored(spread.mapInPandas(count, f"{fields}, {own_} bigint, {task_} bigint"), "numbered")
    sizes = own.groupBy(group, task_).agg((F.max(own_) + 1).alias(rows_))
    before = Window.partitionBy(group).orderBy(task_).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias(group_), F.col(task_).alias(from_), F.coalesce(F.sum(rows_).over(before), F.lit(0)).alias(start_))
    joined = own.join(starts, (own[group] == starts[group_]) & (own[task_] == starts[from_]))
    return joined.select(*columns, (F.col(start_) + F.col(own_)).alias(number))


def sharded(docs: DataFrame, tree: Tree, key: str = "doc_id", name: str = "place") -> DataFrame:
    """Add ``name``, the struct of region, rack and shard; no shuffle.

    Every row gets a place, also one whose key is null; rows of equal keys share theirs. The
    text plays no part. A column of that name is replaced, others stay.
    """
    return docs.withColumn(name, placed(key_of(F.col(key)), tree))
