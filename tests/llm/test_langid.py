import itertools
import random

import numpy as np
import pytest
from corpus import AWKWARD, clashing, frame
from pyspark.sql import functions as F

from wakeline.llm import langid, queries

EN = "the quick brown fox jumps over the lazy dog while thinking of something else that matters".split()
RU = "быстрая коричневая лиса прыгает через ленивую собаку пока думает о чём то другом".split()
DE = "der schnelle braune fuchs springt über den faulen hund während er über etwas anderes nachdenkt".split()


def text_of(pool, seed, count=30):
    return " ".join(random.Random(seed).choices(pool, k=count))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(n, text_of(pool, n), lang, "a", 0) for n in range(30) for pool, lang in ((EN, "en"), (RU, "ru"), (DE, "de"))]
    return langid.learned(frame(spark, rows + AWKWARD[:1]))


def path_by_hand(scores, penalty):
    def value(path):
        return sum(scores[at][label] for at, label in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

    return max(value(path) for path in itertools.product(range(len(scores[0])), repeat=len(scores))), value


@pytest.mark.parametrize("seed", range(10))
def test_viterbi_is_the_best_path(seed):
    draw = np.random.default_rng(seed)
    counts = np.array([6, 5, 5, 2, 1])
    scores, first = draw.normal(size=(counts.sum(), 3)), np.concatenate([[0], np.cumsum(counts)[:-1]])
    labels = langid.best_labels(scores, first, counts, 0.7)
    for start, count in zip(first, counts):
        best, value = path_by_hand(scores[start : start + count], 0.7)
        assert value(labels[start : start + count].tolist()) == pytest.approx(best)


def test_spans_of_mixed_text(model):
    parts = [text_of(EN, 1), text_of(RU, 2), text_of(DE, 3, 60)]
    lang, score, spans = langid.label_texts([" | ".join(parts)], model)[0]
    assert [span["lang"] for span in spans] == ["en", "ru", "de"] and lang == "de" and 0.4 < score < 0.8
    whole = " | ".join(parts)
    assert [whole[span["start"] : span["end"]] for span in spans] == parts


def test_scripts_narrow_the_candidates(model):
    assert langid.label_texts(["щука"], model)[0][0] == "ru"
    assert langid.label_texts(["漢字"], model)[0][0] in model.languages  # of no learned script


def test_letters_of_other_scripts_count_against_the_score(model):
    found = langid.label_texts(["漢字漢字漢字", "the fox " + "漢" * 54, "щука the fox", text_of(EN, 9)], model)
    assert [score for _, score, _ in found[:2]] == [0.0, 0.1] and all(lang in model.languages for lang, *_ in found)
    assert found[2][1] == 0.6 and found[3][1] == 1.0
    assert [row[:2] for row in langid.label_texts(["漢", "the fox"], model, with_spans=False)] == [row[:2] for row in langid.label_texts(["漢", "the fox"], model)]


def test_awkward_rows(spark, model):
    df = clashing(frame(spark, AWKWARD + [(50, text_of(EN, 5, 200_000), "en", "a", 0)]), "lang_pred", "score", "spans")
    found = {(row["doc_id"], row["text"] and row["text"][:9]): row["language"] for row in langid.labelled(df, model).collect()}
    for doc_id in (1, 2, 3, 7):
        own = next(value for key, value in found.items() if key[0] == doc_id)
        assert own["lang"] == "und" and own["score"] == 0.0 and own["spans"] == []
    assert found[(50, text_of(EN, 5, 200_000)[:9])]["lang"] == "en"
    assert langid.labelled(df.limit(0), model).count() == 0


def test_nothing_learned(spark):
    df = frame(spark, AWKWARD)
    model = langid.learned(df.limit(0))
    assert {row["language"]["lang"] for row in langid.labelled(df, model).collect()} == {"und"}


def many_languages(count):
    pools = {f"l{n:03}": ["".join(random.Random(f"{n} {at}").choices("abcdefghijklmnopqrstuvwxyz", k=7)) for at in range(12)] for n in range(count)}
    rows = [(n, text_of(pool, n * 7 + copy), name, "a", 0) for n, (name, pool) in enumerate(pools.items()) for copy in range(1 + (n < 64))]
    return pools, rows


def test_every_language_is_learned(spark):
    pools, rows = many_languages(150)
    model = langid.learned(frame(spark, rows + AWKWARD[:1] + [(9000, None, "of no text", "a", 0)]))
    assert model.languages == sorted([*pools, "of no text"])
    texts = [text_of(pool, 1000 + n) for n, pool in enumerate(pools.values())]
    assert [found[0] for found in langid.label_texts(texts, model)] == list(pools)


def test_languages_held_at_a_time_change_nothing(spark):
    _, rows = many_languages(10)
    texts = [row[1] for row in rows] + [" ".join(row[1] for row in rows[::3]), "щука", ""]
    whole, parts = (langid.learned(frame(spark, rows), settings=langid.Settings(held_languages=held)) for held in (64, 3))
    assert langid.label_texts(texts, parts) == langid.label_texts(texts, whole)
    counts = np.full((10, langid.SETTINGS.buckets), langid.SETTINGS.smoothing)
    for _, text, name, *_ in rows:
        np.add.at(counts[whole.languages.index(name)], langid.words_in([text], langid.SETTINGS.buckets).triples, 1)
    assert np.array_equal(whole.scores(0), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op4_viterbi_language(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97
    assert found.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, tmp_path):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    hidden = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang")))
    hidden.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(queries.op4_viterbi_language(spark, str(tmp_path)).collect()) == sorted(
        queries.op4_viterbi_language(spark, "/root/testdata/sf0.001").collect()
    )
