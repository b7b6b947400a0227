import hashlib
import re
import zlib

import pytest
from corpus import AWKWARD, clashing, corpus, frame
from pyspark.sql import functions as F

from wakeline.llm import manifest, queries


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda match: match.group().lower(), text)
    parts = [None if value is None else str(value) for value in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if part is None else f"{len(part.encode())}:{part}" for part in parts))


def climb(nodes, arity):
    """The root of a list of digests, and the digests left and right of the way of each."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, place in zip(ways, at, strict=True):
            first = place - place % arity
            way.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + arity])))
        nodes = [digest("".join(nodes[first : first + arity])) for first in range(0, len(nodes), arity)]
        at = [place // arity for place in at]
    return nodes[0], ways


def plain(rows, arity=8):
    langs = sorted({row[2] for row in rows}, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees, found = [], []
    for lang in langs:
        own = sorted((row for row in rows if row[2] == lang), key=lambda row: (row[0] is not None, row[0] or 0, leaf_of(row)))
        trees.append((own, *climb([leaf_of(row) for row in own], arity)))
    root, above = climb([subroot for _, subroot, _ in trees], arity)
    for (own, subroot, ways), upper in zip(trees, above, strict=True):
        for row, way in zip(own, ways, strict=True):
            now = leaf_of(row, lower=row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for left, right in way + upper:
                now = digest(left + now + right)
            proof = digest("".join(left + right for left, right in way + upper))
            found.append((row[0], leaf_of(row), subroot, root, proof, now, now == root))
    return sorted(found, key=repr)


def many_groups():
    rows = corpus() + AWKWARD
    return rows + [(2000 + n, f"Text {n} X", f"l{n % 11}", None, n) for n in range(60)] + [(3000, "Lone ÄÖ", "z", "a", 1)] * 3


def test_query_equals_plain_version(spark, tmp_path):
    frame(spark, many_groups()).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == plain(many_groups())


@pytest.mark.parametrize("arity", [2, 3])
def test_steps_lead_to_the_root(spark, arity):
    rows = many_groups()
    leaf = manifest.leaf_digest(*[F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")])
    found = manifest.manifest(frame(spark, rows).withColumn("leaf", leaf).drop("text"), arity=arity)
    found = found.withColumn("folded", manifest.folded(F.col("leaf"), F.col("steps"))).collect()
    expected = plain(rows, arity)
    assert sorted((row["doc_id"], row["leaf"], row["subroot"], row["root"]) for row in found if row["doc_id"] is not None) == sorted(
        row[:4] for row in expected if row[0] is not None
    )
    assert all(row["folded"] == row["root"] for row in found) and len(found) == len(rows)


def test_one_row_is_its_own_root(spark):
    row = manifest.manifest(spark.createDataFrame([(1, "en", "abc")], "doc_id bigint, lang string, leaf string")).collect()[0]
    assert (row["subroot"], row["root"], row["steps"]) == ("abc", "abc", [])


def test_empty_tables_and_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([(n, "en", digest(str(n))) for n in range(20)], "doc_id bigint, lang string, leaf string")
    names = ("tree", "at", "nodes", "place", "task", "Root", "tie", "run", "digests", "above", "digest")
    found = manifest.manifest(clashing(rows, *names))
    assert found.columns == ["doc_id", "lang", "leaf", "tree", "at", "nodes", "place", "task", "tie", "run", "digests", "above", "digest", "subroot", "root", "steps"]
    assert {row["tree"] for row in found.collect()} == {"kept"} and found.select("root").distinct().count() == 1
    assert manifest.manifest(rows.limit(0)).count() == 0
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_merkle_manifest(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        manifest.manifest(rows, arity=1)


def test_a_run_is_asked_for_once(spark):
    nodes = spark.range(100).selectExpr("'t' tree", "id at", "100L nodes", "string(id) digest")
    runs = {row["run"]: row["digests"] for row in manifest.runs_of(nodes, 8).collect()}
    assert runs == {run: [str(at) for at in range(8 * run, min(8 * run + 8, 100))] for run in range(13)}
