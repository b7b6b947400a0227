import re
from collections import Counter

from corpus import AWKWARD, clashing, corpus, frame

from wakeline.llm import quality, queries


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {at + step for at in range(len(words) - 2) if grams[tuple(words[at : at + 3])] > 1 for step in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_measures_equal_brute_force(spark):
    rows = corpus() + AWKWARD + [(8, "a\nb\na\n a\nb\n\n", "en", "a", 0), (9, "x y x y x y # <p> " * 30, "en", "a", 0)]
    found = quality.judged(frame(spark, rows)).select("doc_id", "text", "quality.*", "base_failed").collect()
    assert len(found) == len(rows)
    for row in found:
        own = (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"])
        assert own == base_by_hand(row["text"])


def test_rules_are_a_table(spark):
    text = "the cat of words and more " * 20 + " ".join(f"x{n}" for n in range(200))
    df = frame(spark, [(1, text, "en", "a", 0)])
    assert quality.judged(df).first()["kept"]
    strict = (quality.Rule("long", "n_words", None, 10), quality.Rule("never", "symbol_ratio", -1.0, 2.0))
    row = quality.judged(df, strict).first()
    assert row["broken_rules"] == ["long"] and not row["kept"] and not row["base_failed"]
    assert quality.judged(df, ()).first()["kept"]


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"the word{n} of" for n in range(60))
    kinds = [prose, prose.upper(), " ".join(f"word{n}### of$$$" for n in range(60)), " ".join(f"word{n}" for n in range(99))]
    rows = [(n, text, "en", "a", 0) for n, text in enumerate(kinds)]
    assert [row["kept"] for row in quality.judged(frame(spark, rows)).orderBy("doc_id").collect()] == [True, False, False, False]


def test_other_columns_stay_and_an_empty_table_is_empty(spark):
    df = clashing(frame(spark, AWKWARD), "words", "lines", "n_words", "grams")
    row = quality.judged(df).where("doc_id = 4").first()
    assert row["words"] == row["n_words"] == "kept"
    assert quality.judged(df.limit(0)).count() == 0


def test_query_uses_no_python(spark):
    plan = queries.op1_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
