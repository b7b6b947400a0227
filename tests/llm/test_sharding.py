import zlib

from corpus import AWKWARD, clashing, corpus, frame
from pyspark.sql import functions as F

from wakeline.llm import queries, sharding


def shards(spark, tree, keys=3000):
    df = sharding.sharded(spark.range(keys).withColumnRenamed("id", "doc_id"), tree)
    return [row[0] for row in df.orderBy("doc_id").select("place.shard").collect()]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before = shards(spark, sharding.tree_of(8))
    for count in (9, 10, 11):
        after = shards(spark, sharding.tree_of(count))
        moved = [(a, b) for a, b in zip(before, after) if a != b]
        assert moved and all(b == count - 1 for _, b in moved)
        before = after


def test_weights_are_shares(spark):
    tree = {"a": {"k": {0: 1.0, 1: 3.0}}, "b": {"l": {2: 4.0}, "m": {3: 0.0}}}
    found = shards(spark, tree, 20_000)
    for shard, share in ((0, 1 / 8), (1, 3 / 8), (2, 1 / 2), (3, 0)):
        assert abs(found.count(shard) / 20_000 - share) < 0.02


def test_a_changed_weight_moves_rows_of_its_subtrees_only(spark):
    tree = sharding.tree_of(8)
    before = shards(spark, tree)
    tree["r0"]["k1"][2] = 2.0
    region, rack = {0, 1, 2, 3}, {2, 3}
    for a, b in zip(before, shards(spark, tree)):
        assert a == b or b in region
        assert a == b or a not in rack or b == 2
        assert a == b or a not in region or b in rack


def test_query_on_awkward_rows(spark, tmp_path):
    rows = corpus() + AWKWARD + [(5, "one", "en", "a", 3)] * 500
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_hash_tree_sharding(spark, str(tmp_path)).collect()
    expected = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((row["size"], row["text_crc32"]) for row in found) == expected
    slots = {}
    for row in found:
        assert row["grown_shard"] in (row["shard"], 8)
        slots.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    order = sorted((row["shard"], row["slot"], row["doc_id"] is not None, row["doc_id"] or 0) for row in found)
    assert order == sorted(order, key=lambda row: (row[0], row[2], row[3], row[1]))


def test_other_columns_and_empty_tables(spark):
    df = clashing(frame(spark, AWKWARD), "region", "rack", "shard", "draw", "start")
    placed = sharding.sharded(df, sharding.tree_of(8)).withColumn("group", F.col("place.shard"))
    row = sharding.numbered(placed.drop("place"), "group", ["doc_id"], "slot").where("doc_id = 4").first()
    assert row["shard"] == row["start"] == "kept" and row["slot"] >= 0
    assert sharding.numbered(placed.drop("place").limit(0), "group", ["doc_id"], "slot").count() == 0


def test_columns_of_helper_names_stay(spark):
    df = clashing(spark.range(20).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "doc_id % 3 as shard"), "_own", "_task", "_tie", "_rows")
    rows = sharding.numbered(df, "shard", ["doc_id"], "slot").collect()
    assert {(row["shard"], row["slot"]) for row in rows} == {(n % 3, n // 3) for n in range(20)} and {row["_own"] for row in rows} == {"kept"}
