"""Language identification of spans in mixed text.

A word, a run of letters, is scored for each language by the log probabilities of the
letter triples around its letters. The script of its first letter narrows the languages to
those that use this script. Viterbi then finds the labels of a text's words with the best
sum of scores less a penalty for each change of language; runs of equal labels are spans.

The model has a row for each language, of the buckets of triples found in it, counted over all
texts to learn from with partial counts per task. So its size is bounded by languages x buckets
whatever the corpus, and a language with few texts has a short row; none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import text_lengths

# First code points of blocks, and the script that begins there.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "other"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x2C60, "latin"),
    (0x2C80, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3130, "hangul"),
    (0x3190, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB07, "other"),
    (0x20000, "han"),
    (0x323B0, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
SPAN = "array<struct<start:bigint,end:bigint,lang:string>>"
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15  # of letter triples
    held_languages: int = 64  # counted or scored at a time in one task; changes no result
    smoothing: float = 0.5
    script_share: float = 0.001  # of a language's letters, to count as its script
    foreign: float = -30.0  # score of a letter in a script that the language does not use
    switch_penalty: float = 12.0


SETTINGS = Settings()


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, its lower case, its script."""
    letters, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            letters[point] = True
            small = letter.lower()
            if len(small) == 1:
                lower[point] = ord(small)
    starts = np.array([start for start, _ in SCRIPTS])
    scripts = np.array([NAMES.index(name) for _, name in SCRIPTS], np.int8)
    return letters, lower, scripts[np.searchsorted(starts, np.arange(0x110000), "right") - 1]


@dataclass
class Words:
    """The words of several texts: triples of their letters, and where each word begins."""

    triples: np.ndarray  # a bucket for each letter
    first: np.ndarray  # place of each word's first letter among the letters
    script: np.ndarray  # of each word
    begin: np.ndarray  # code points, counted in the word's own text
    end: np.ndarray
    text: np.ndarray  # number of the word's text


def words_in(texts: list[str], buckets: int) -> Words:
    letters, lower, scripts = tables()
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), "<u4")
    is_letter = letters[points]
    small = np.where(is_letter, lower[points], 0).astype(np.uint32)
    places = np.flatnonzero(is_letter)
    hashed = small[places - 1] * np.uint32(0x9E3779B1) ^ small[places] * np.uint32(0x85EBCA6B)
    hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE35) + small[places + 1] * np.uint32(0x27D4EB2F)
    hashed ^= hashed >> np.uint32(13)
    opens, closes = ~is_letter[places - 1], ~is_letter[places + 1]
    begin, end = places[opens], places[closes] + 1
    bounds = np.cumsum([1, *[len(text) + 1 for text in texts]])
    text = np.searchsorted(bounds, begin, "right") - 1
    return Words(
        (hashed & np.uint32(buckets - 1)).astype(np.int64),
        np.flatnonzero(opens),
        scripts[points[begin]],
        begin - bounds[text],
        end - bounds[text],
        text,
    )


def portions(lengths: list[int], letters: int) -> Iterator[list[int]]:
    """Numbers of texts, longest first, in portions of about so many characters."""
    portion, size = [], 0
    for at in sorted(range(len(lengths)), key=lambda at: -lengths[at]):
        portion.append(at)
        size += lengths[at]
        if size >= letters:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


@dataclass
class Model:
    languages: list[str]
    first: np.ndarray  # place of each language's row among the buckets found, and the end of the last
    buckets: np.ndarray
    found: np.ndarray  # score of each bucket found
    unseen: np.ndarray  # score of any other bucket, for each language
    uses: np.ndarray  # script x language
    settings: Settings

    def scores(self, start: int) -> np.ndarray:
        """Language x bucket, of the held number of languages from ``start``."""
        if self.kept is None or self.kept[0] != start:
            end = min(start + self.settings.held_languages, len(self.languages))
            table = np.repeat(self.unseen[start:end, None], self.settings.buckets, axis=1)
            row = slice(self.first[start], self.first[end])
            table[np.repeat(np.arange(end - start), np.diff(self.first[start : end + 1])), self.buckets[row]] = self.found[row]
            self.kept = start, table
        return self.kept[1]

    def word_scores(self, words: Words) -> np.ndarray:
        """Word x language."""
        parts = range(0, len(self.languages), self.settings.held_languages)
        scored = [np.add.reduceat(self.scores(start)[:, words.triples], words.first, axis=1) for start in parts]
        return np.concatenate(scored).T.astype(np.float64)

    kept: tuple[int, np.ndarray] | None = None


def counted(docs: DataFrame, text: str, lang: str, settings: Settings) -> DataFrame:
    """Letters by language and bucket of triples, and by language and script as ``-1 - script``."""

    def rows(triples: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name in triples:
            some, of_script = np.flatnonzero(triples[name]), np.flatnonzero(scripts[name])
            bucket = np.concatenate([some, -1 - of_script])
            letters = np.concatenate([triples[name][some], scripts[name][of_script]])
            arrays = [pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "bucket", "letters"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).dictionary_encode()
            of_row, lengths = labels.indices.to_numpy(zero_copy_only=False), text_lengths(batch.column(1))
            for code, name in enumerate(labels.dictionary.to_pylist()):
                if name not in triples and len(triples) >= settings.held_languages:
                    yield from rows(triples, scripts)
                    triples.clear(), scripts.clear()
                own = triples.setdefault(name, np.zeros(settings.buckets, np.int64))
                of_scripts = scripts.setdefault(name, np.zeros(len(NAMES), np.int64))
                places = np.flatnonzero(of_row == code)
                for portion in portions(lengths[places].tolist(), 500_000):
                    words = words_in(batch.column(1).take(pa.array(places[portion])).to_pylist(), settings.buckets)
                    own += np.bincount(words.triples, minlength=settings.buckets)
                    of_scripts += np.bincount(words.script, words.end - words.begin, len(NAMES)).astype(np.int64)
        yield from rows(triples, scripts)

    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    partial = labelled.mapInArrow(count, "lang string, bucket int, letters bigint")
    return partial.groupBy("lang", "bucket").agg(F.sum("letters").alias("letters"))


def learned(docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = SETTINGS) -> Model:
    """The model of labelled texts, of every label; rows with a null label or text teach nothing."""
    languages = sorted(row["lang"] for row in docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang")).distinct().collect())
    scripts = np.zeros((len(languages), len(NAMES)))
    # at most languages x (buckets + scripts) rows, whatever the corpus
    number = (F.array_position(F.lit(languages).cast("array<string>"), F.col("lang")) - 1).cast("int")
    counts = counted(docs, text, lang, settings).select(number.alias("number"), "bucket", "letters").toPandas()
    of, bucket, letters = (counts[name].to_numpy(np.int64) for name in ("number", "bucket", "letters"))
    other = bucket < 0
    scripts[of[other], -1 - bucket[other]] = letters[other]
    uses = scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= settings.script_share
    of, bucket, letters = of[~other], bucket[~other], letters[~other]
    order = np.lexsort((bucket, of))
    of, bucket, letters = of[order], bucket[order], letters[order]
    total = np.bincount(of, letters, len(languages)) + settings.smoothing * settings.buckets
    found = np.log((letters + settings.smoothing) / total[of]).astype(np.float32)
    unseen = np.log(settings.smoothing / total).astype(np.float32)
    first = np.searchsorted(of, np.arange(len(languages) + 1))
    return Model(languages, first, bucket.astype(np.int32), found, unseen, uses.T, settings)


def best_labels(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi over the rows of ``scores`` for many texts at once, those with most words first.

    Text i owns the ``counts[i]`` rows from ``first[i]``. Every change of label costs ``penalty``.
    """
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    value, steps = scores[first].copy(), []
    active = np.searchsorted(-counts, -np.arange(counts[0]), "left")
    for at in range(1, counts[0]):
        running = active[at]
        now = value[:running]
        best = now.argmax(1)
        jump = now[np.arange(running), best] - penalty
        changes = jump[:, None] > now
        value[:running] = np.where(changes, jump[:, None], now) + scores[first[:running] + at]
        steps.append((changes, best))
    label = value.argmax(1)
    for at in range(counts[0] - 1, -1, -1):
        running = active[at]
        labels[first[:running] + at] = label[:running]
        if at:
            changes, best = steps[at - 1]
            own = label[:running]
            label[:running] = np.where(changes[np.arange(running), own], best, own)
    return labels


def label_texts(texts: list[str] | pa.Array, model: Model, with_spans: bool = True) -> list[tuple[str, float, list[dict]]]:
    """Language, its share of the letters, and spans of each text.

    A word of a script that its label does not use counts for no language, but among the letters.
    """
    settings, found = model.settings, [(UNKNOWN, 0.0, [])] * len(texts)
    if not model.languages:
        return found
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.string())
    lengths = text_lengths(texts).tolist()
    for portion in portions(lengths, max(10_000, 2_000_000 // len(model.languages))):
        words = words_in([text or "" for text in texts.take(pa.array(portion)).to_pylist()], settings.buckets)
        if not len(words.first):
            continue
        scores = model.word_scores(words)
        size = words.end - words.begin
        uses = model.uses[words.script]
        known = uses.any(1, keepdims=True)
        scores = np.where(known, np.where(uses, scores, settings.foreign * size[:, None]), 0.0)
        order, first, counts = np.unique(words.text, return_index=True, return_counts=True)
        by_size = np.argsort(-counts, kind="stable")
        labels = best_labels(scores, first[by_size], counts[by_size], settings.switch_penalty)
        letters = np.zeros((len(portion), len(model.languages)), np.int64)
        np.add.at(letters, (words.text, labels), np.where(uses[np.arange(len(labels)), labels], size, 0))
        main, total = letters.argmax(1), np.bincount(words.text, size, len(portion))
        share = letters[np.arange(len(portion)), main] / np.maximum(total, 1)
        spans: dict[int, list[dict]] = {}
        for number in order.tolist():
            found[portion[number]] = (model.languages[main[number]], float(share[number]), spans.setdefault(number, []))
        if not with_spans:
            continue
        starts = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1])]))
        ends = np.concatenate([starts[1:], [len(labels)]])
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            span = {"start": int(words.begin[start]), "end": int(words.end[end - 1]), "lang": model.languages[labels[start]]}
            spans[int(words.text[start])].append(span)
    return found


def detector(docs: DataFrame, model: Model, with_spans: bool = True):
    """A function of a text column: the struct of ``lang``, ``score`` and, if wanted, ``spans``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang", "score", "spans"] if with_spans else ["lang", "score"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    kinds = [pa.string(), pa.float64(), pa.list_(span)]

    @F.arrow_udf("lang string, score double" + (f", spans {SPAN}" if with_spans else ""))
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            columns = list(zip(*label_texts(texts, shared.value, with_spans), strict=True)) or [[], [], []]
            arrays = [pa.array(column, kind) for column, kind, _ in zip(columns, kinds, names)]
            yield pa.StructArray.from_arrays(arrays, names)

    # said to be not deterministic, so that a filter on its results does not run it a second time
    return detect.asNondeterministic()


def labelled(docs: DataFrame, model: Model, text: str = "text", name: str = "language", with_spans: bool = True) -> DataFrame:
    """Add ``name``: the main language, its share of the letters, and all spans if wanted.

    Spans are given in code points of the whole text. A null text, and one without a letter,
    has the language ``und``, the score 0 and no span; so has every text if nothing was
    learned. Letters of scripts that no language uses belong to spans around them but count
    against the score, so a text of such letters only has the score 0. Equal counts of letters
    go to the first language by name. Rows stay as they are, repeated ones included; a column of
    that name is replaced.
    """
    return docs.withColumn(name, detector(docs, model, with_spans)(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Every fourth document by a hash of its number, a null one never; these teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
