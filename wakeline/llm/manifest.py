"""A Merkle manifest of a data set, built by self-joins of sibling nodes.

Leaves are numbered within each group. At every level the first node of each run of ``arity``
nodes computes the numbers of its siblings (number XOR 1 for binary trees, the other slots by
their offset else), finds their digests by an equijoin of the level with itself, and gives the
run's digests and the parent. The groups' roots are the leaves of one more tree, whose root names
the data set.

All siblings of a node are in its run, so proofs are handed down from run to run: a run's way up
is its parent's place in the run above and that run's way. The joins shrink by the arity with
each level, a leaf meets one row, and no node meets more than its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.ranks import free_names, ranked
from wakeline.llm.text import drop_stored, stored

STEPS = "array<struct<left:string,right:string>>"


def leaf_digest(*columns: Column) -> Column:
    """The digest of a row: each value as its length in UTF-8 bytes, a colon and the text; a null as ``-``."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to through the digests on its left and right at every level."""
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]).cast("binary"), 256))


def run_of(at: str, arity: int) -> Column:
    return F.expr(f"`{at}` div {arity}")


def run_numbers(first: Column, arity: int) -> Column:
    """The numbers of a run's nodes, from the first one's."""
    if arity == 2:
        return F.array(first, first.bitwiseXOR(F.lit(1).cast("bigint")))
    return F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda shift: first + shift)


def runs_of(nodes: DataFrame, arity: int) -> DataFrame:
    """``tree, run, nodes, digests`` of every run of ``tree, at, nodes, digest``, in order of the slots."""
    asked = nodes.where(F.col("at") % arity == 0).select(
        "tree", run_of("at", arity).alias("run"), "nodes", F.explode(run_numbers(F.col("at"), arity)).alias("at")
    )
    found = asked.where("at < nodes").join(nodes.select("tree", "at", "digest"), ["tree", "at"])
    digests = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda node: node["digest"])
    return found.groupBy("tree", "run", "nodes").agg(digests.alias("digests"))


def levels_of(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The runs of all levels of all trees, and ``tree, digest`` of the roots; none of an empty table."""
    widest = nodes.agg(F.max("nodes")).collect()[0][0]
    if widest is None:
        return [], None
    levels, roots = [], nodes.where("nodes = 1").select("tree", "digest")
    while widest > 1:
        level = stored(runs_of(nodes.where("nodes > 1"), arity), f"level-{len(levels)}")
        levels.append(level)
        parent = F.sha2(F.array_join("digests", "").cast("binary"), 256)
        more = F.expr(f"(nodes + {arity - 1}) div {arity}")
        nodes = level.select("tree", F.col("run").alias("at"), more.alias("nodes"), parent.alias("digest"))
        roots = roots.unionByName(nodes.where("nodes = 1").select("tree", "digest"))
        widest = -(-widest // arity)
    return levels, roots


def step_of(digests: str, at: str, arity: int) -> Column:
    """What stands on the left and on the right of a node in its run."""
    slot = (F.col(at) % arity).cast("int")
    left, right = F.slice(digests, F.lit(1), slot), F.slice(digests, slot + 2, F.lit(arity))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def with_steps(nodes: DataFrame, runs: DataFrame, at: str, tree: str, arity: int) -> DataFrame:
    """``nodes`` with ``steps``, from ``tree, run, digests, above`` of their runs."""
    above = runs.select(F.col("tree").alias(tree), F.col("run").alias(f"{at}_run"), F.col("digests").alias(f"{at}_digests"), F.col("above").alias(f"{at}_above"))
    joined = nodes.withColumn(f"{at}_run", run_of(at, arity)).join(above, [tree, f"{at}_run"])
    steps = F.array_prepend(f"{at}_above", step_of(f"{at}_digests", at, arity))
    return joined.withColumn("steps", steps).drop(f"{at}_run", f"{at}_digests", f"{at}_above")


def ways(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int, tree: str, at: str, count: str) -> DataFrame:
    """``nodes`` with ``steps`` up to the last root; ``tree, steps`` of ``tops`` lead on from each tree's root."""
    upper = tops.select("tree", F.col("steps").alias("above"))
    runs = None
    for level in reversed(levels):
        here = level.where(F.col("nodes") <= arity).join(upper, "tree").select("tree", "run", "digests", "above")
        if runs is not None:
            below = with_steps(level.where(F.col("nodes") > arity), runs, "run", "tree", arity)
            here = here.unionByName(below.select("tree", "run", "digests", F.col("steps").alias("above")))
        runs = here
    lone = nodes.where(F.col(count) == 1).join(tops.select(F.col("tree").alias(tree), "steps"), tree)
    if runs is None:
        return lone
    return with_steps(nodes.where(F.col(count) > 1), runs, at, tree, arity).unionByName(lone)


def manifest(rows: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf", arity: int = 8) -> DataFrame:
    """Add ``subroot``, ``root`` and ``steps``, the digests on the way from each row's ``leaf`` to the root.

    ``leaf`` is a digest as hexadecimal text, as from :func:`leaf_digest`, and never null. In each
    group leaves ascend by ``order``, nulls first, and among equal ones by leaf, so repeated rows
    are leaves next to each other whose steps may be exchanged. As long as a group has several
    nodes, every ``arity`` in a row, in the last run fewer or one, become the digest of their joined
    texts; what remains is the ``subroot``. Subroots ascend by group, a null group first, then by
    code point, and give ``root`` in the same way. An empty table gives no row. Columns of the three
    names are replaced, others stay; pass only those that are wanted, as they are shuffled. The
    number of groups may be large too.
    """
    if arity < 2:
        raise ValueError("a run has two nodes or more")
    results = ("subroot", "root", "steps")
    rows = rows.select(*[F.col(f"`{name}`") for name in rows.columns if name.lower() not in results])
    tree, at, nodes = free_names(rows, "tree", "at", "nodes")
    name = F.col(f"`{group}`").cast("string")
    kept = stored(rows.withColumn(tree, F.coalesce(F.concat(F.lit("="), name), F.lit(""))), "leaves")
    order_by = [F.col(f"`{order}`").asc_nulls_first(), F.col(f"`{leaf}`").asc()]
    placed = stored(ranked(kept, tree, order_by, at, nodes), "numbered-leaves")
    drop_stored(kept)
    digests = F.col(f"`{leaf}`").alias("digest")
    levels, subroots = levels_of(placed.select(F.col(tree).alias("tree"), F.col(at).alias("at"), F.col(nodes).alias("nodes"), digests), arity)
    if subroots is None:
        return rows.withColumns({"subroot": F.lit("").cast("string"), "root": F.lit("").cast("string"), "steps": F.array().cast(STEPS)})
    subroots = stored(subroots.withColumn("all", F.lit("all")), "subroots")
    upper_nodes = ranked(subroots, "all", [F.col("tree").asc()], "at", "nodes")
    upper, root = levels_of(upper_nodes.select(F.col("all").alias("tree"), "at", "nodes", "digest"), arity)
    root_digest = root.collect()[0]["digest"]
    end = root.select("tree", F.array().cast(STEPS).alias("steps"))
    tops = stored(ways(upper_nodes, upper, end, arity, "all", "at", "nodes").select("tree", "digest", "steps"), "tops")
    found = ways(placed, levels, tops, arity, tree, at, nodes)
    named = found.join(tops.select(F.col("tree").alias(tree), F.col("digest").alias("subroot")), tree)
    return named.withColumn("root", F.lit(root_digest)).select(*rows.columns, *results)
