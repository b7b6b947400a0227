import hashlib
import random

import pytest
from corpus import AWKWARD, clashing, corpus, frame, words

from wakeline.llm import queries, substrings


def by_hand(rows, window):
    first, split = {}, [(row[0], (row[1] or "").encode().split()) for row in rows]
    for doc_id, own in sorted(split, key=lambda row: row[0]):
        for at in range(len(own) - window + 1):
            gram = tuple(own[at : at + window])
            first[gram] = min(first.get(gram, (doc_id, at)), (doc_id, at))
    found = []
    for doc_id, own in split:
        covered = [False] * len(own)
        for at in range(len(own) - window + 1):
            if first[tuple(own[at : at + window])] < (doc_id, at):
                covered[at : at + window] = [True] * window
        kept = b" ".join(word for word, gone in zip(own, covered) if not gone)
        found.append((doc_id, len(own), sum(covered), hashlib.sha256(kept).hexdigest()))
    return sorted(found)


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus(8, 80)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(row) for row in queries.op9_path_compaction(spark, str(tmp_path)).collect()) == by_hand(rows, 20)


@pytest.mark.parametrize("window,inner", [(2, 1), (5, 2), (5, 5), (20, 3), (20, 20)])
def test_repeating_texts_equal_brute_force(spark, window, inner):
    draw = random.Random(window)
    rows = [(n, " ".join(draw.choices("abc", k=draw.randrange(60))), "en", "a", 0) for n in range(30)]
    rows += [(100 + n, "a b c " * draw.randrange(20), "en", "a", 0) for n in range(5)]
    cut = substrings.without_repeats(frame(spark, rows), window, inner).collect()
    digest = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(" ".join(r["text"].split()).encode()).hexdigest()) for r in cut]
    assert sorted(digest) == by_hand(rows, window)


def test_lines_and_spans_stay(spark):
    passage = " ".join(words(1, 20, 10**6))
    rows = [(1, f"first line\n{passage}\nlast", "en", "a", 0), (2, f"é one\n two  {passage}\nthree\n", "en", "a", 0)]
    found = {row["doc_id"]: row for row in substrings.without_repeats(frame(spark, rows)).collect()}
    assert found[1]["text"] == rows[0][1] and found[1]["spans"] == []
    assert found[2]["text"] == "é one\n two  three\n"
    assert [tuple(span) for span in found[2]["spans"]] == [(3, 20)] and found[2]["n_removed"] == 20


def test_rows_of_one_number(spark):
    passage = " ".join(words(2, 25, 10**6))
    rows = [(1, passage, "en", "a", 0), (1, passage, "en", "a", 0), (1, "x " + passage, "en", "a", 0), (None, passage, "en", "a", 0)]
    found = [(row["doc_id"], row["n_removed"]) for row in substrings.without_repeats(frame(spark, rows)).collect()]
    assert sorted(found, key=str) == [(1, 25), (1, 25), (1, 25), (None, 0)]
    assert sorted(row["n_removed"] for row in substrings.without_repeats(frame(spark, rows[:3])).collect()) == [0, 0, 25]


def test_awkward_rows_other_columns_and_empty_tables(spark):
    df = clashing(frame(spark, AWKWARD), "place", "content", "inner", "first", "found")
    rows = substrings.without_repeats(df).collect()
    assert sorted((r["text"] for r in rows), key=str) == sorted((row[1] for row in AWKWARD), key=str)
    assert {r["place"] for r in rows} == {"kept"} and sum(r["n_removed"] for r in rows) == 0
    assert substrings.without_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.without_repeats(df, 100, 5)


def test_texts_without_a_number_are_documents_of_their_own(spark):
    passage = words(3, 40, 10**6)
    rows = [(None, " ".join(words(n, 30, 10**6) + passage), "en", "a", 0) for n in (10, 11)] + [(1, " ".join(passage), "en", "a", 0)]
    cut = substrings.without_repeats(frame(spark, rows + rows[:1])).collect()
    assert sorted(row["n_removed"] for row in cut if row["doc_id"] is None) in ([0, 0, 40], [0, 40, 40])
    assert [row["n_removed"] for row in cut if row["doc_id"] == 1] == [40]


def test_columns_of_helper_names_stay(spark):
    rows = clashing(frame(spark, corpus(3, 10)), "_id", "_cut", "_places", "_checks")
    cut = substrings.without_repeats(rows)
    assert {"_id", "_cut", "_places", "_checks"} <= set(cut.columns) and {row["_id"] for row in cut.collect()} == {"kept"}
