import re
from collections import Counter

import pytest
from corpus import AWKWARD, clashing, frame

from wakeline.llm import licenses, queries

TEXTS = [
    "Released under the MIT License.",
    "x\nLicensed under the Apache License, Version 2.0.\nLicensed under the Apache-License  VERSION 2",
    "Licensed under CC BY-NC 4.0. under the mit license cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "under the MIT licenses; under the mitt license; éunder the mit license",
    "mit mit mit license version 2 apache",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "license of the gnu general public",
    "mit " * 3000 + "released under the mit license",
]


def base_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        at = [n for n in range(len(words)) if words[n : n + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def scanned(df):
    return licenses.scanned(df, licenses.document_frequencies(df, licenses.NOTICES))


def test_base_equals_brute_force(spark):
    rows = AWKWARD + [(100 + n, text, "en", "a", 0) for n, text in enumerate(TEXTS)]
    for row in scanned(frame(spark, rows)).select("text", "license.*").collect():
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == base_by_hand(row["text"])


def test_labels_of_the_method(spark):
    rows = [(n, text, "en", "a", 0) for n, text in enumerate(TEXTS)]
    found = scanned(frame(spark, rows)).orderBy("doc_id").select("license.*").collect()
    labels = [["mit"], ["apache-2"], ["cc-by-nc", "mit"], ["gpl-3"], ["mit"], [], ["bsd"], [], ["mit"]]
    assert [row["labels"] for row in found] == labels
    assert found[4]["base_labels"] == [] and found[4]["score"] == 0.6  # the key phrase and one more word
    assert [found[at]["score"] for at in (0, 1, 2, 3, 6, 8)] == [1.0] * 6
    assert all(row["score"] == 0.0 for row in found if not row["labels"])
    assert found[8]["matches"][0]["first_word"] == 3000


def test_a_notice_with_a_changed_word_is_still_placed(spark):
    text = "Redistribution and use in source and binary forms with and without modification are allowed"
    row = scanned(frame(spark, [(1, text, "en", "a", 0)])).select("license.*").first()
    assert row["labels"] == ["bsd"] and row["score"] == 12 / 14


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower())


def matches_by_hand(text, texts):
    holding = Counter(word for other in texts for word in set(words_by_hand(other)))
    words, found = words_by_hand(text), []
    for notice in licenses.NOTICES:
        wording, key = notice.words, notice.key.split()
        rare = sorted(set(wording), key=lambda word: (holding[word], word))[: licenses.RARE]
        for start in range(-len(wording), len(words)):
            same = [word for at, word in enumerate(wording) if start + at >= 0 and words[start + at : start + at + 1] == [word]]
            key_stands = start + notice.key_at >= 0 and words[start + notice.key_at :][: len(key)] == key
            if key_stands and sum(word in rare for word in same) >= 2 and len(same) / len(wording) >= licenses.MIN_SHARE:
                found.append((notice.label, start, len(same) / len(wording)))
    return found


@pytest.mark.parametrize(
    "text",
    [
        "We compared source and binary forms of verbs.",
        "This file is not under the gnu general public license.",
        "He spoke of public domain and of the terms of the Mozilla Public License.",
    ],
)
def test_a_key_phrase_alone_is_no_licence(spark, text):
    row = scanned(frame(spark, [(1, text, "en", "a", 0)])).select("license.*").first()
    assert row["labels"] == [] and row["score"] == 0.0


def test_a_cut_off_beginning_and_a_late_change_leave_the_rest_placed(spark):
    mit = next(notice for notice in licenses.NOTICES if notice.label == "mit" and len(notice.words) > 40)
    cut = mit.words[6:]
    cut[-3:] = ["these", "two", "rules"]
    row = scanned(frame(spark, [(1, " ".join(cut), "en", "a", 0)])).select("license.*").first()
    assert tuple(row["matches"][-1]) == ("mit", -6, (len(mit.words) - 9) / len(mit.words))


def test_no_notice_displaces_another(spark):
    ordinary = "free software 2 4 0 v and or by to any person charge subject terms binary mozilla cc granted"
    several = "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0. " + TEXTS[3]
    every = [" x ".join([ordinary, *[notice.text for notice in notices], ordinary]) for notices in (licenses.NOTICES, licenses.NOTICES[::-1])]
    texts = [several, *every, *[f"{ordinary} {notice.text} {ordinary}" for notice in licenses.NOTICES], *TEXTS]
    rows = [(n, text, "en", "a", 0) for n, text in enumerate(texts)] + [(1000 + n, word, "en", "a", 0) for n, word in enumerate(ordinary.split() * 3)]
    found = {row["doc_id"]: row for row in scanned(frame(spark, rows)).select("doc_id", "license.*").collect()}
    for n, text in enumerate(texts):
        assert [tuple(match) for match in found[n]["matches"]] == matches_by_hand(text, [row[1] for row in rows]), text
    assert found[0]["labels"] == ["apache-2", "cc-by-nc", "gpl-3"]
    assert found[1]["labels"] == found[2]["labels"] == sorted({notice.label for notice in licenses.NOTICES})
    assert all(found[3 + n]["score"] == 1.0 for n in range(len(licenses.NOTICES)))


def test_other_columns_and_empty_tables(spark):
    df = clashing(frame(spark, AWKWARD), "words", "hits", "votes", "places", "matches", "word")
    assert scanned(df).where("doc_id = 4").first()["words"] == "kept"
    assert scanned(df.limit(0)).count() == 0


def test_query_uses_no_python(spark):
    plan = queries.op8_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sql_agrees_where_a_file_has_several_notices(spark, tmp_path):
    from oracle import connect, from_duckdb, from_spark

    texts = [" / ".join(notice.text for notice in licenses.NOTICES), *[notice.text for notice in licenses.NOTICES]]
    texts += ["Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0. Redistribute it under the GNU General Public License, version 3."]
    texts += [notice.key for notice in licenses.NOTICES] + ["license mit license", None, ""]
    frame(spark, [(n, text, "en", "a", 0) for n, text in enumerate(texts)]).coalesce(1).write.parquet(f"{tmp_path}/docs")
    (part,) = (tmp_path / "docs").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    found = from_spark(queries.op8_license_scan(spark, str(tmp_path)))
    assert found == from_duckdb(connect(str(tmp_path)), queries.oracle_sql()["op8_license_scan"])
