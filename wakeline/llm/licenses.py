"""License scans by a positional index of rare words, in built-in functions only.

Templates are licence notices and paragraphs of licence texts. Of each template the ``rare``
words with the highest inverse document frequency are indexed, with their places in it. A file
looks up its words there: every place of such a word, less the word's place in a template, is a
vote for where the template begins. The postings are intersected by sorting the votes: a
template is placed where two votes or more are equal. A place counts if the template's mandatory
key phrase stands there word by word and ``min_share`` of all its words agree. Words of one
template never take the place of another's. A copy in which fewer than two of the rare words
keep their distance is not found; templates of ``rare`` or fewer different words have no such miss.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: what stands between words once A-Z are lower case, and before that.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE, MIN_SHARE = 8, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    key: str  # a part of the text that has to stand word by word

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(at for at in range(len(words)) if words[at : at + len(key)] == key)


# Phrases that are licence marks wherever they stand.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
GNU = (
    "free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by "
    "the free software foundation either version {1} of the license or at your option any later version"
)
# Usual wording of licence notices and paragraphs of licence texts, lower case, without punctuation.
NOTICES = (
    Notice("mit", "released under the mit license", "the mit license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "obtaining a copy of this software"),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions",
        "to deal in the software without restriction",
    ),
    Notice("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Notice(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        "except in compliance with the license",
    ),
    Notice("gpl-3", "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    Notice("gpl-3", GNU.format("", 3), "either version 3 of the license"),
    Notice("gpl-2", GNU.format("", 2), "either version 2 of the license"),
    Notice("gpl", "redistribute it and or modify it under the terms of the gnu general public license", "under the terms of the gnu general public license"),
    Notice("lgpl", "licensed under the gnu lesser general public license", "licensed under the gnu lesser general public license"),
    Notice("lgpl", GNU.format("lesser ", "3"), "under the terms of the gnu lesser general public license"),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    Notice(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
        "to endorse or promote products derived from this software",
    ),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license"),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    Notice(
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
        "redistribute it freely subject to the following restrictions",
        "to alter it and redistribute it freely",
    ),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
)
# A vote is the template's number in the upper bits, the place of its first word plus this in the lower ones.
TEMPLATE_BITS, BEFORE = 40, 1 << 20


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def words_of(text: Column) -> Column:
    """Lower-case words; only A-Z are changed."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def may_match(text: Column, phrases: list[str]) -> Column:
    """False only for texts without the longest word of any phrase."""
    anchors = sorted({max(phrase.split(), key=len) for phrase in phrases})
    inside = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    return F.coalesce(F.rlike(text, F.lit(rf"(?i)(?<!{inside})({'|'.join(anchors)})(?!{inside})")), F.lit(False))


def places(words: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase's words stand one after the other."""
    first, *rest = phrase.split()

    def stands(at: Column) -> Column:
        same = F.get(words, at) == F.lit(first)
        for step, word in enumerate(rest, 1):
            same = same & F.coalesce(F.get(words, at + F.lit(step)) == F.lit(word), F.lit(False))
        return same

    return F.filter(F.transform(words, lambda word, at: at), stands)


def document_frequencies(docs: DataFrame, notices: tuple[Notice, ...], text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of all texts, and of those with each word of the notices; one row per word comes back."""
    vocabulary = sorted({word for notice in notices for word in notice.words})
    present = F.array_intersect(F.lit(vocabulary), words_of(F.col(text)))
    counts = docs.select(F.explode(F.array_append(present, F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    found = {row["word"]: row["texts"] for row in counts.collect()}
    return found.pop("", 0), {word: found.get(word, 0) for word in vocabulary}


def by_rarity(total: int, frequencies: dict[str, int]) -> dict[str, float]:
    """Inverse document frequencies, rarest word first; ties by the word."""
    idf = {word: math.log((total + 1) / (count + 1)) for word, count in frequencies.items()}
    return dict(sorted(idf.items(), key=lambda item: (-item[1], item[0])))


def postings(notices: tuple[Notice, ...], rarity: dict[str, float], rare: int) -> dict[str, list[int]]:
    """Of each template's ``rare`` rarest words, all places: word -> votes of that word at place 0 of a file."""
    rank, index = list(rarity).index, {}
    for number, notice in enumerate(notices):
        looked_up = sorted(set(notice.words), key=rank)[:rare]
        for at, word in enumerate(notice.words):
            if word in looked_up:
                index.setdefault(word, []).append((number << TEMPLATE_BITS) + BEFORE - at)
    return index


def scanned(
    docs: DataFrame,
    frequencies: tuple[int, dict[str, int]],
    notices: tuple[Notice, ...] = NOTICES,
    phrases: dict[str, str] = PHRASES,
    text: str = "text",
    name: str = "license",
    rare: int = RARE,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Add ``name``: words, places of the phrases, base and all labels, score and matches.

    ``matches`` lists label, first word and agreement of each placed template; the agreement is
    the share of its words that stand where they should, and ``score`` the highest one, 0
    without a match. A null text counts as empty and has no places and no labels. Rows stay
    as they are, repeated ones included; a column of that name is replaced. ``frequencies``
    come from :func:`document_frequencies`, over all texts. No shuffle, no Python.
    """
    index = postings(notices, by_rarity(*frequencies), rare)
    taken = "_".join(docs.columns)
    names = {part: f"{part}_{taken}" for part in ("words", "votes", "places", "matches")}
    col = {part: F.col(f"`{column}`") for part, column in names.items()}
    nothing = F.array().cast("array<string>")
    flagged = may_match(F.col(text), [*phrases, *[notice.key for notice in notices]])
    found = docs.withColumn(names["words"], F.when(flagged, words_of(F.col(text))).otherwise(nothing))

    base = F.array(*[F.struct(F.lit(label).alias("label"), places(col["words"], phrase).alias("at")) for phrase, label in phrases.items()])
    found = found.withColumns({names["votes"]: votes(col["words"], index), names["places"]: base})
    found = found.withColumn(names["matches"], matches(col["words"], col["votes"], notices, min_share))

    starts = F.flatten(F.transform(col["places"], lambda phrase: phrase["at"]))
    base_labels = F.array_distinct(
        F.transform(F.filter(col["places"], lambda phrase: F.size(phrase["at"]) > 0), lambda phrase: phrase["label"])
    )
    own = F.transform(col["matches"], lambda match: match["label"])
    result = F.struct(
        word_count(F.col(text)).alias("n_words"),
        F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_sort(base_labels).alias("base_labels"),
        F.array_sort(F.array_union(base_labels, own)).alias("labels"),
        F.coalesce(F.array_max(F.transform(col["matches"], lambda match: match["agreement"])), F.lit(0.0)).alias("score"),
        col["matches"].alias("matches"),
    )
    return found.withColumn(name, result).drop(*names.values())


def votes(words: Column, index: dict[str, list[int]]) -> Column:
    """Where a file's indexed words place their templates, equal votes side by side."""
    listed = F.create_map(*[part for word, own in index.items() for part in (F.lit(word), F.array(*[F.lit(vote).cast("bigint") for vote in own]))])
    numbered = F.transform(words, lambda word, at: F.struct(word.alias("word"), at.alias("at")))
    hits = F.filter(numbered, lambda hit: hit["word"].isin(list(index)))
    return F.sort_array(F.flatten(F.transform(hits, lambda hit: F.transform(listed[hit["word"]], lambda vote: vote + hit["at"]))))


def matches(words: Column, votes: Column, notices: tuple[Notice, ...], min_share: float) -> Column:
    """Label, first word and agreement of each template that two votes place, whose key phrase and share of words stand there."""
    wordings = F.array(*[F.array(*map(F.lit, notice.words)) for notice in notices])
    keys = F.array(*[F.array(*map(F.lit, notice.key.split())) for notice in notices])
    keys_at, labels = F.array(*[F.lit(notice.key_at) for notice in notices]), F.array(*[F.lit(notice.label) for notice in notices])

    def of(table: Column, vote: Column) -> Column:
        return F.get(table, F.shiftright(vote, TEMPLATE_BITS).cast("int"))

    def first_word(vote: Column) -> Column:
        return (vote.bitwiseAND(F.lit((1 << TEMPLATE_BITS) - 1)) - F.lit(BEFORE)).cast("int")

    def second_of_its_kind(vote: Column, at: Column) -> Column:
        return F.get(votes, at - 1).eqNullSafe(vote) & ~F.get(votes, at - 2).eqNullSafe(vote)

    def key_stands(vote: Column) -> Column:
        begin, key = first_word(vote) + of(keys_at, vote), of(keys, vote)
        return F.when(begin >= 0, F.slice(words, begin + 1, F.size(key)) == key).otherwise(F.lit(False))

    def agreement(vote: Column) -> Column:
        start, wording = first_word(vote), of(wordings, vote)
        there = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.size(wording))
        wanted = F.slice(wording, F.greatest(-start, F.lit(0)) + 1, F.size(wording))
        agreed = F.filter(F.zip_with(there, wanted, lambda word, own: word == own), lambda same: same)
        return F.size(agreed) / F.size(wording).cast("double")

    placed = F.filter(F.filter(votes, second_of_its_kind), key_stands)
    found = F.transform(
        placed,
        lambda vote: F.struct(of(labels, vote).alias("label"), first_word(vote).cast("bigint").alias("first_word"), agreement(vote).alias("agreement")),
    )
    return F.filter(found, lambda match: match["agreement"] >= min_share)
