"""The pipeline against a plain version of its five stages, and copies without a number of their own."""

import re
import struct
import zlib

import corpus_pipeline
import xxhash
from corpus import corpus, frame, words
from test_decontaminate import tiling_by_hand
from test_nearduplicates import sets_by_hand
from tokenizers import Tokenizer

from wakeline.llm import decontaminate, packing, queries

LETTERS = re.compile(r"[^\W\d_]+")


def signed(number):
    return number - 2**64 if number >= 2**63 else number


def order_of(row):
    """The least number first, none last, then the hash of the text."""
    return row[0] is None, row[0] or 0, signed(xxhash.xxh64_intdigest(row[1].encode(), seed=42))


def language(rows):
    """One language is learned here, in Latin script."""
    kept = []
    for row in rows:
        found = LETTERS.findall(row[1] or "")
        known = sum(len(word) for word in found if ord(word[0]) < 0x370)
        if found and known >= 0.3 * sum(map(len, found)):
            kept.append(row)
    return kept


def near_duplicates(rows):
    rows = sorted({(row[0], row[1]): row for row in rows}.values(), key=order_of)
    sets = [own for _, own in sets_by_hand(rows, 5)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if own == old else own for own in group]
    return [row for at, row in enumerate(rows) if group[at] == at]


def repeated_spans(rows, window=20):
    def place(row, at):
        return (row[0] is not None, row[0] or 0, "" if row[0] is not None else row[1]), at

    first = {}
    for row in rows:
        own = row[1].split()
        for at in range(len(own) - window + 1):
            gram = tuple(own[at : at + window])
            first[gram] = min(first.get(gram, place(row, at)), place(row, at))
    kept = []
    for row in rows:
        own, gone = row[1].split(), set()
        for at in range(len(own) - window + 1):
            if first[tuple(own[at : at + window])] < place(row, at):
                gone |= set(range(at, at + window))
        parts = re.findall(r"[^ \t-\r]+[ \t-\r]*", row[1])
        lead = row[1][: len(row[1]) - len("".join(parts))]
        if not own or len(gone) < len(own):
            kept.append((row[0], lead + "".join(part for at, part in enumerate(parts) if at not in gone)))
    return kept


def decontamination(rows, items, least=5):
    kept = []
    for row in rows:
        doc, hit = decontaminate.tokens_of(row[1]), False
        for _, text in items:
            item = decontaminate.tokens_of(text or "")
            if item:
                matched = sum(size for *_, size in tiling_by_hand(doc, item, min(least, len(item))))
                hit |= matched >= 0.6 * len(item) and matched > 0
        if not hit:
            kept.append(row)
    return kept


def packed(rows):
    tokenizer, found = Tokenizer.from_file(queries.tokenizer()[0]), []
    for doc_id, text in rows:
        ids, start = [*tokenizer.encode(text, add_special_tokens=False).ids, 1], 0
        for length in packing.piece_lengths(len(ids), 2048):
            found.append((doc_id, start, length, zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length])), len(ids)))
            start += length
    return sorted(found, key=repr)


def planted():
    item = words(61, 12, 10**6)
    rows = [row for row in corpus(4, 40) if row[0] != 1000]
    own = words(62, 90, 10**6)
    rows += [(2000, " ".join(own), "en", "a", 0), (None, " ".join(own), "en", "a", 0), (None, " ".join(own[1:]), "en", "a", 0)]
    rows += [(2001, " ".join(words(63, 50, 10**6)), "en", "a", 0)] * 2
    rows += [(2002, " ".join([*own[:40], *words(64, 60, 10**6)]), "en", "a", 0), (None, " ".join([*words(65, 60, 10**6), *own[20:60]]), "en", "a", 0)]
    rows += [(2003, " ".join(words(66, 30, 10**6) + item + words(67, 5, 10**6)), "en", "a", 0), (2004, "漢字漢字漢字 " * 30, None, "a", 0)]
    rows += [(2005, "Быстрая лиса " * 9 + "the fox", None, "a", 0), (2006, "<|endoftext|> the fox  and\n\n" + " ".join(words(68, 20)), "en", "a", 0)]
    return rows, [(1, " ".join(item)), (2, None), (3, "")]


def test_run_equals_plain_version(spark, tmp_path):
    rows, items = planted()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    expected = packed(decontamination(repeated_spans(near_duplicates(language(rows))), items))
    assert sorted(map(tuple, found), key=repr) == expected


def test_copies_that_share_a_number_or_have_none_go(spark):
    own, other = words(1, 100, 10**6), words(2, 100, 10**6)
    rows = [(7, " ".join(own)), (7, " ".join([*own, "more"])), (7, " ".join(other)), (None, " ".join(own)), (None, " ".join([*other, "x"]))]
    rows += [(None, text) for text in ("alone without a number", "another one of them", "another one of them")] + [(9, None), (None, "")]
    docs = frame(spark, [(*row, "en", "a", 0) for row in rows])
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((row["doc_id"] or 0, len((row["text"] or "").split()) // 100) for row in kept) == [(0, 0), (0, 0), (0, 0), (7, 1), (7, 1), (9, 0)]
