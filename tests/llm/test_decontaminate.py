import random

import numpy as np
import pytest
from corpus import AWKWARD, clashing, corpus, frame, words

from wakeline.llm import decontaminate

ITEMS = "item_id bigint, text string"


def tiling_by_hand(doc, item, least):
    free_doc, free_item, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best, pairs = least, []
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and free_item[a + n] and free_doc[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                if n > best:
                    best, pairs = n, []
                if n == best:
                    pairs.append((a, b))
        if not pairs:
            return tiles
        for a, b in pairs:
            if all(free_item[a : a + best]) and all(free_doc[b : b + best]):
                free_item[a : a + best] = [False] * best
                free_doc[b : b + best] = [False] * best
                tiles.append((b, a, best))


@pytest.mark.parametrize("seed", range(30))
def test_tiling_equals_brute_force(seed):
    draw = random.Random(seed)
    doc, item = ([draw.randrange(4) for _ in range(draw.randrange(1, 60))] for _ in range(2))
    least = draw.randrange(1, 5)
    found = decontaminate.tiling(np.array(doc, np.uint64), np.array(item, np.uint64), least)
    assert found == tiling_by_hand(doc, item, least)


def found_in(spark, rows, items, **more):
    df = decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, ITEMS), **more)
    return {(row["doc_id"], row["item_id"]): row for row in df.collect()}


def test_passages_reordered_edited_and_clean(spark):
    item = words(1, 40, 10**6)
    around = words(2, 100, 10**6)
    texts = [
        around[:30] + item + around[30:],
        around[:10] + item[20:] + around[10:50] + item[:20] + around[50:],
        around + item[:15],
        around,
        [word.upper() + "," for word in item],
        item[:20] + ["edit"] + item[21:],
    ]
    rows = [(n, " ".join(text), "en", "a", 0) for n, text in enumerate(texts)]
    found = found_in(spark, rows + AWKWARD[:4], [(7, " ".join(item)), (8, None), (9, ""), (10, "too short"), (None, " ".join(item))])
    assert {key for key in found if key[1] == 7} == {(0, 7), (1, 7), (4, 7), (5, 7)}
    assert {key[1] for key in found} == {7, None}
    assert found[(1, 7)]["coverage"] == 1.0 and len(found[(1, 7)]["tiles"]) == 2
    assert found[(5, 7)]["matched"] == 39


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    item = words(3, 30, 10**6)
    rows = corpus() + [(5000, " ".join(words(4, 50) + item), "en", "a", 0)] * 3
    sent = found_in(spark, rows, [(1, " ".join(item))])
    monkeypatch.setattr(decontaminate, "MAX_SENT_BYTES", -1)
    assert found_in(spark, rows, [(1, " ".join(item))]) == sent
    monkeypatch.setattr(decontaminate, "MAX_SENT_SEEDS", 0)
    assert found_in(spark, rows, [(1, " ".join(item))]) == sent and set(sent) == {(5000, 1)}


@pytest.mark.parametrize("seed", range(20))
def test_windows_left_out_stay_below_the_threshold(seed):
    draw = random.Random(seed)
    tokens, least, threshold = draw.randrange(1, 40), draw.randrange(1, 6), draw.choice([0.0, 0.3, 0.6, 1.0])
    places = list(range(max(tokens - least + 1, 1)))
    texts = [draw.choice([0, 1, 5, 5, 100]) for _ in places]
    telling = set(decontaminate.telling_places(texts, places, tokens, least, threshold))
    out = [place for place in places if texts[place] and place not in telling]
    covered = {token for place in out for token in range(place, min(place + least, tokens))}
    assert not out or len(covered) < threshold * tokens
    assert not telling or not out or max(texts[place] for place in telling) <= min(texts[place] for place in out)


def test_a_phrase_of_all_texts_and_items_pairs_only_those_that_share_more(spark):
    phrase = words(20, 15, 10**6)
    items = [(n, phrase + words(100 + n, 15, 10**6)) for n in range(30)]
    rows = [(n, " ".join(phrase + words(200 + n, 40, 10**6)), "en", "a", 0) for n in range(60)]
    rows += [(100 + n, " ".join(words(300 + n, 10, 10**6) + items[n][1]), "en", "a", 0) for n in range(3)]
    rows += [(None, rows[-1][1], "en", "a", 0), (104, " ".join(items[5][1][:20]), "en", "a", 0), (105, " ".join(phrase), "en", "a", 0)]
    benchmark = [(n, " ".join(text)) for n, text in items] + [(None, " ".join(items[2][1]))]
    found = found_in(spark, rows, benchmark)
    assert set(found) == {(100, 0), (101, 1), (102, 2), (None, 2), (102, None), (None, None), (104, 5)}
    assert {row["matched"] for key, row in found.items() if key[0] != 104} == {30} and found[(104, 5)]["matched"] == 20


def test_every_pair_equals_brute_force(spark):
    rows = corpus(4, 40)
    items = [(n, " ".join((row[1] or "").split()[5:45])) for n, row in enumerate(rows) if row[1]]
    found = found_in(spark, rows, items)
    expected = {}
    for doc_id, text, *_ in rows:
        doc = decontaminate.tokens_of(text or "")
        if len(doc) > 2000:
            continue
        for item_id, item in items:
            tokens = decontaminate.tokens_of(item)
            if len(tokens) >= 5 and set(tokens) & set(doc):
                matched = sum(n for _, _, n in tiling_by_hand(doc, tokens, 5))
                if matched >= 0.6 * len(tokens):
                    expected[(doc_id, item_id)] = matched
    assert {key: row["matched"] for key, row in found.items() if key[0] < 1000} == {k: v for k, v in expected.items() if k[0] < 1000}


def test_short_items_equal_brute_force(spark):
    rows = [(n, " ".join(words(70 + n, 40, 12)), "en", "a", 0) for n in range(12)] + AWKWARD
    items = [(n, " ".join(words(170 + n, 1 + n % 7, 12))) for n in range(28)] + [(100, "One."), (101, "!"), (102, "text without")]
    expected = {}
    for doc_id, text, *_ in rows:
        doc = decontaminate.tokens_of(text or "")
        for item_id, item in items:
            tokens = decontaminate.tokens_of(item)
            matched = sum(n for _, _, n in tiling_by_hand(doc, tokens, min(5, len(tokens)))) if tokens else 0
            if tokens and matched >= 0.6 * len(tokens):
                expected[(doc_id, item_id)] = matched
    found = found_in(spark, rows, items)
    assert {key: row["matched"] for key, row in found.items()} == expected
    assert {(4, 100), (5, 100), (None, 102)} <= set(expected)


def test_scripts_without_blanks(spark):
    question = "日本で一番高い山は何ですか、そしてその高さは何メートルありますか"
    thai = "ภูเขาที่สูงที่สุดในประเทศไทยคือภูเขาอะไร"
    texts = ["前書き。" + question + "続き", question.replace("番", "晩"), "日本の山は美しい", thai, "abc 12" + question + "xyz", "一番"]
    found = found_in(spark, [(n, text, "ja", "a", 0) for n, text in enumerate(texts)], [(1, question), (2, thai), (3, "一番")])
    assert set(found) == {(0, 1), (1, 1), (4, 1), (3, 2), (0, 3), (4, 3), (5, 3)}
    assert found[(1, 1)]["item_tokens"] - found[(1, 1)]["matched"] == 5  # the four tokens before the changed one are too few to match
    assert decontaminate.tokens_of("Abc漢字9x カ_é") == ["abc", "漢", "字", "9x", "カ", "é"]


def test_empty_tables_and_other_columns(spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    df = clashing(frame(spark, [(None, "a b c d e f g", "en", "a", 0)]), "seed", "tokens", "items", "text_hash")
    assert decontaminate.contaminated(df, items).first()["item_id"] == 1
    assert decontaminate.contaminated(df.limit(0), items).count() == 0
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0
