"""Mixing sources to target weights by a time-varying curriculum, in built-in functions only.

Every source has a schedule: its weight at given times of the training, linear in between. The
integral of the schedule is the source's share of the mix. A source's documents, drawn in a
fixed random order, make up a stream of words that is read again from the start once it ends.
The integral up to a time, scaled to the source's target, is the demand for words up to that
time; inverting it at a document's place in the stream gives its training position. Sorting by
position, over ranges, gives the order of the training.

A source may hold most rows: its stream is cut into slots by the leading digits of the draw,
words are summed up per slot, and windows hold one slot each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wakeline.llm.ranks import ranked
from wakeline.llm.text import drop_stored, stored, words_of


@dataclass(frozen=True)
class Curriculum:
    times: tuple[float, ...] = (0.0, 0.5, 1.0)
    # weights at these times, for sources in turn: the integrals are 5, 2 and 1
    schedules: tuple[tuple[float, ...], ...] = ((7.0, 5.0, 3.0), (2.0, 2.0, 2.0), (0.5, 1.0, 1.5))
    share: float = 1.5  # of the words of all sources that the mix takes
    repeats: int = 2  # how often a document is taken at most
    seed: str = "mix"
    slot_rows: int = 2_000  # about so many rows of a source meet in one task; changes no result

    def integrals(self, schedule: tuple[float, ...]) -> list[float]:
        """The integral of a schedule from the first time to each of its times."""
        found = [0.0]
        for at in range(1, len(self.times)):
            found.append(found[-1] + (schedule[at - 1] + schedule[at]) / 2 * (self.times[at] - self.times[at - 1]))
        return found

    @property
    def weights(self) -> list[float]:
        return [self.integrals(schedule)[-1] for schedule in self.schedules]


CURRICULUM = Curriculum()
DIGITS = 8  # of a draw that give its slot


def position_of(demand: Column, schedule: tuple[float, ...], curriculum: Curriculum) -> Column:
    """The time at which the integral of the schedule reaches the share ``demand`` of its whole.

    Between two times the integral grows by ``low * x + slope * x * x / 2``.
    """
    reached, times = curriculum.integrals(schedule), curriculum.times
    wanted, found = demand * F.lit(reached[-1]), F.lit(times[-1])
    for at in reversed(range(len(times) - 1)):
        if reached[at + 1] > reached[at]:
            rest = F.greatest(wanted - F.lit(reached[at]), F.lit(0.0))
            slope = (schedule[at + 1] - schedule[at]) / (times[at + 1] - times[at])
            root = F.sqrt(F.greatest(F.lit(schedule[at] ** 2) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
            inside = F.when(rest > 0, F.lit(2.0) * rest / (F.lit(schedule[at]) + root)).otherwise(F.lit(0.0))
            found = F.when(wanted <= F.lit(reached[at + 1]), F.lit(times[at]) + inside).otherwise(found)
    return found


def sized(docs: DataFrame, curriculum: Curriculum, text: str = "text") -> DataFrame:
    """``doc_id, source, tree, size, draw`` of every row: its words, and its place in the random order."""
    key = F.concat(F.lit(f"{curriculum.seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.coalesce(F.col(text), F.lit("")))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        # nulls last: no other key begins with the greater sign
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(">")).alias("tree"),
        F.size(words_of(F.col(text))).cast("bigint").alias("size"),
        F.md5(key.cast("binary")).alias("draw"),
    )


def sources_of(rows: DataFrame, curriculum: Curriculum) -> DataFrame:
    """``tree, turn, source_size, rows, weight, target`` of every source.

    Targets share the mix by weight, up to ``repeats`` times the source; the excess is shared
    again until none is above. Each round is one aggregate, as in Newton's method, so a few
    rounds do even for many sources.
    """
    sizes = rows.groupBy("tree").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    placed = ranked(sizes.withColumn("all", F.lit("all")), "all", [F.col("tree").asc()], "place", "sources")
    turn = (F.col("place") % len(curriculum.schedules)).cast("int")
    weight = F.element_at(F.lit(curriculum.weights), turn + 1)
    most = F.lit(float(curriculum.repeats)) * F.col("source_size")
    weighed = stored(placed.select("tree", turn.alias("turn"), "source_size", "rows", weight.alias("weight"), most.alias("most")), "sources")
    whole = weighed.agg(F.sum("source_size"), F.sum("weight")).collect()[0]
    goal = curriculum.share * (whole[0] or 0)
    level, left = goal / (whole[1] or 1.0), whole[1]
    while left:
        above = F.col("most") <= F.lit(level) * F.col("weight")
        full, still = weighed.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).collect()[0]
        if still == left:
            break
        left = still
        level = (goal - full) / left if left else float("inf")
    target = F.least("most", F.lit(level) * F.col("weight")) if level != float("inf") else F.col("most")
    return weighed.select("tree", "turn", "source_size", "rows", "weight", target.alias("target"))


def mixed(docs: DataFrame, curriculum: Curriculum = CURRICULUM, text: str = "text") -> DataFrame:
    """The mix in training order: a row for every time that a document is taken.

    ``docs`` has ``doc_id, source`` and a text; further columns are not used. Returns ``doc_id,
    source, size, source_size, target, doc_taken, copy, taken, position``: the document's words,
    those of its source, the source's target, the words taken of the document in all copies and in
    this one, and the position between the first and the last time. A document that the mix does
    not take has one row at the end, with nulls for ``copy`` and ``position``. Targets are met to
    the word: the document at which a source's demand ends is cut there.

    Sources are numbered by code point, a null one last, and take the schedules in turn. A null
    text has no words. Rows of equal number, source and text are places of their own in the
    stream. The same table gives the same rows on any partitioning. An empty one gives none.
    """
    rows = stored(sized(docs, curriculum, text), "sized")
    sources = stored(sources_of(rows, curriculum), "targets")
    most_rows = sources.agg(F.max("rows")).collect()[0][0] or 1
    slots = -(-most_rows // curriculum.slot_rows)
    slot = F.expr(f"cast(conv(substring(draw, 1, {DIGITS}), 16, 10) as bigint) * {slots} div {16**DIGITS}")
    alike = rows.groupBy("tree", slot.alias("slot"), "draw", "doc_id", "size", "source").agg(F.count(F.lit(1)).alias("rows"))

    of_slot = rows.groupBy("tree", slot.alias("slot")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("tree").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_slot.join(sources.drop("rows"), "tree").withColumn("begin", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")

    words = F.col("size") * F.col("rows")
    inside = Window.partitionBy("tree", "slot").orderBy("draw", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("ahead", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(starts, ["tree", "slot"])
    each = placed.withColumn("again", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)))
    begin = F.col("begin") + F.col("ahead") + F.col("again") * F.col("size")

    demand = F.floor(F.col("target") + F.lit(0.5))

    def copy(number: int) -> Column:
        at = begin + F.lit(number - 1) * F.col("source_size")
        taken = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), demand - at))
        middle = (at + taken / F.lit(2.0)) / demand
        position = F.lit(None).cast("double")
        for turn, schedule in enumerate(curriculum.schedules):
            position = F.when(F.col("turn") == turn, position_of(middle, schedule, curriculum)).otherwise(position)
        return F.struct(F.lit(number).alias("copy"), taken.alias("taken"), F.when(taken > 0, position).alias("position"))

    copies = F.array(*[copy(number) for number in range(1, curriculum.repeats + 1)])
    taken = each.withColumn("copies", F.filter(copies, lambda one: one["taken"] > 0))
    total = F.aggregate("copies", F.lit(0).cast("bigint"), lambda words, one: words + one["taken"])
    plan = stored(
        taken.withColumn("doc_taken", total).select(
            "doc_id", "source", "size", "source_size", "target", "doc_taken", "draw", F.inline_outer("copies")
        ),
        "mix",
    )
    drop_stored(rows)
    ordered = plan.withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint"))).orderBy(F.col("position").asc_nulls_last(), "draw", "copy")
    return ordered.drop("draw").select("doc_id", "source", "size", "source_size", "target", "doc_taken", "copy", "taken", "position")
