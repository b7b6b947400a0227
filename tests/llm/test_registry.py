"""The SQL of the corpus queries, and the pipeline against a plain version."""

import __spark_entry__ as registry
import corpus_pipeline
import pytest
from corpus import AWKWARD, DOCS, clashing, corpus, frame, words
from oracle import connect, from_duckdb, from_spark

from wakeline.llm import langid, nearduplicates, queries


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_hash_tree_sharding", "op6_bayesian_minhash", "op7_chat_round_trip", "op8_license_scan", "op9_path_compaction", "op11_merkle_manifest", "op12_curriculum_mix", "op13_conversation_repair"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert from_spark(queries.queries()[name](spark, sf)) == from_duckdb(connect(sf), queries.oracle_sql()[name])


def test_all_are_registered():
    names = [name for name in registry.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert registry.queries()["pipeline"] is corpus_pipeline.run


def tables(spark, path, rows, items):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_decide_as_planted(spark, tmp_path):
    item, passage = words(50, 30, 10**6), words(51, 60, 10**6)
    clean = [words(100 + n, 80, 10**6) for n in range(12)]
    rows = [(n, " ".join(text), "en", "a", 1) for n, text in enumerate(clean)]
    rows += [(20, " ".join(clean[0]), "en", "a", 1), (21, " ".join([*clean[1], "more"]), "en", "a", 1)]
    rows += [(22 + n, " ".join(words(200 + n, 40, 10**6) + passage), "en", "a", 1) for n in range(3)]
    rows += [(30, " ".join(words(300, 50, 10**6) + item), "en", "a", 1), (31, "12345 !!!", "en", "a", 1), (32, None, "en", "a", 1)]
    sf, kept, docs = tables(spark, tmp_path, rows, [(1, " ".join(item))]), {}, frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            kept[name] = {row["doc_id"]: row["text"] for row in docs.collect()}
    everything = {row[0] for row in rows}
    assert everything - set(kept["language"]) == {31, 32}
    assert set(kept["language"]) - set(kept["near-duplicates"]) == {20, 21}
    assert set(kept["repeated-spans"]) == set(kept["near-duplicates"])
    assert [len(kept["repeated-spans"][n].split()) for n in (22, 23, 24)] == [100, 40, 40]
    assert set(kept["repeated-spans"]) - set(kept["decontamination"]) == {30}
    pieces = docs.groupBy("doc_id").sum("length").collect()
    assert {row[0] for row in pieces} == set(kept["decontamination"])


def test_run_on_awkward_rows(spark, tmp_path):
    sf = tables(spark, tmp_path, corpus() + AWKWARD, [(1, None), (2, "")])
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {row["doc_id"] for row in rows}
    docs = frame(spark, corpus() + AWKWARD)
    known = langid.labelled(docs, langid.learned(docs.where(~langid.held_out(docs["doc_id"])))).where("language.lang <> 'und' and language.score >= 0.3")
    expected = nearduplicates.grouped(known).where("kept")
    assert kept <= {row["doc_id"] for row in expected.collect()}
    assert {1000, 4, 6, None} <= kept and not kept & {1, 2, 3, 5, 7}


def test_run_on_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_ignore_other_columns(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [(1, "a b c d e f g")])
    docs = clashing(frame(spark, corpus(size=20), DOCS), "n", "node", "place", "tokens")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, sf).columns == list(corpus_pipeline.COLUMNS)
