"""Removal of repeated long spans by compacting the paths of a De Bruijn graph.

Windows of ``window`` words are the edges of the graph, their first and last ``window - 1``
words its nodes. Edges are not shuffled one by one: consecutive windows of a text that have
the same smallest inner window, at the same place, form a path, about one for every seven
words. An inner window of eight words rarely occurs twice by chance. All occurrences of an edge lie on paths of one smallest inner window, so

1. inner windows that occur once are dropped with all their edges;
2. where all paths of an inner window are equal, none of them branches: the path stays
   compact, and its first occurrence is the first one of each of its edges;
3. where they differ, as at the ends of a copied passage, the paths fall into their edges,
   which are joined one by one.

What is left are occurrences with an earlier one: coordinates and a hash of their words,
which are verified on the text before anything is cut from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.ranks import free_names
from wakeline.llm.text import BASES, Content, WordHashes, drop_stored, stored, text_portions

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NO_ID = -(2**63)  # null numbers become this and a hash of the text, before all others
STEP = 64  # a place is start * STEP + number of edges


def joined_words(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of several texts in a row, and where each text begins and ends."""
    split = [text.encode("utf-8", "replace").split() for text in texts]
    bounds = np.cumsum([0, *map(len, split)])
    return hashes([word for words in split for word in words]), bounds


def paths_in(words: np.ndarray, bounds: np.ndarray, window: int, inner: int):
    """Text, start, number of edges, hash of the inner window and of all words, of every path."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    starts = np.flatnonzero(bounds[text + 1] - np.arange(len(words)) >= window) if len(words) else np.empty(0, np.int64)
    if not len(starts):
        return [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    content = Content(words)
    small = content(np.arange(len(words) - inner + 1), inner)
    choices = window - inner + 1
    smallest = starts + np.lib.stride_tricks.sliding_window_view(small, choices)[starts].argmin(1)
    first = np.flatnonzero(np.concatenate([[True], (smallest[1:] != smallest[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    edges = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    return text[begin], begin - bounds[text[begin]], edges, small[smallest[first]], content(begin, edges + window - 1)


def paths(docs: DataFrame, window: int, inner: int) -> DataFrame:
    """``_id, place, content, inner`` of every path of ``_id, text``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_portions(batch.column(1)):
                words, bounds = joined_words(texts, hashes)
                text, start, edges, small, content = paths_in(words, bounds, window, inner)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(text + first)),
                        pa.array(start * STEP + edges),
                        pa.array(content.view(np.int64)),
                        pa.array(small.view(np.int64)),
                    ],
                    names=["_id", "place", "content", "inner"],
                )

    return docs.mapInArrow(find, "_id bigint, place bigint, content bigint, inner bigint")


def listed_places(found: DataFrame) -> DataFrame:
    """``_id`` and two arrays: the places in its text, and the hashes they were found for."""
    listed = found.groupBy("_id").agg(F.collect_set(F.struct("place", "content")).alias("found"))
    return listed.select(
        "_id",
        F.transform("found", lambda entry: entry["place"]).alias("_places"),
        F.transform("found", lambda entry: entry["content"]).alias("_checks"),
    )


def sound(content: Content, count: int, places: np.ndarray, checks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of edges of those places whose words are the ones they were found for."""
    start, edges = places // STEP, places % STEP
    inside = start + edges + window - 1 <= count
    start, edges, checks = start[inside], edges[inside], checks[inside].view(np.uint64)
    same = content(start, edges + window - 1) == checks
    return start[same], edges[same]


def edges_of(docs: DataFrame, branching: DataFrame, window: int) -> DataFrame:
    """``_id, place, content, other`` for every edge of the branching paths."""
    listed = listed_places(branching)
    schema = "_id bigint, place bigint, content bigint, other bigint"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, all_places, all_checks = (batch.column(at) for at in (0, 2, 3))
            for first, texts in text_portions(batch.column(1)):
                parts = []
                for at, text in enumerate(texts, first):
                    words = hashes(text.encode("utf-8", "replace").split())
                    content = Content(words)
                    places, checks = (np.array(column[at].as_py(), np.int64) for column in (all_places, all_checks))
                    start, edges = sound(content, len(words), places, checks, window)
                    each = np.unique(np.repeat(start, edges) + np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges))
                    other = Content(words, BASES[1])(each, window)
                    parts.append((np.full(len(each), at), each * STEP + 1, content(each, window).view(np.int64), other.view(np.int64)))
                rows, *columns = (np.concatenate(column) for column in zip(*parts, strict=True))
                arrays = [ids.take(pa.array(rows)), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", "place", "content", "other"])

    return docs.join(listed, "_id").select("_id", "text", "_places", "_checks").mapInArrow(find, schema)


def later(occurrences: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """The occurrences that are not the first one of their key."""
    joined = occurrences.join(firsts, keys)
    return joined.where((F.col("_id") != F.col("first._id")) | (F.col("place") != F.col("first.place"))).select("_id", "place", "content")


def repeats(docs: DataFrame, window: int, inner: int) -> DataFrame:
    """``_id, place, content`` of all paths and edges of ``_id, text`` that occur earlier too."""
    # What is counted for each key is a table of its own: Spark can then split a key with very many
    # rows among the tasks of a join, which it cannot do for a join that shares a stage with a count.
    all_paths = stored(paths(docs, window, inner), "paths")
    counts = all_paths.groupBy("inner").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("inner")
    repeated = stored(counts, "repeated-keys")
    again = stored(all_paths.join(repeated, "inner", "left_semi"), "repeated-paths")
    drop_stored(all_paths)
    drop_stored(repeated)
    first = F.min(F.struct("_id", "place")).alias("first")
    groups = stored(again.groupBy("inner").agg((F.min("content") == F.max("content")).alias("straight"), first), "path-groups")
    straight = groups.where("straight").select("inner", "first")
    branching = again.join(groups.where("not straight").select("inner"), "inner", "left_semi")
    edges = stored(edges_of(docs, branching, window), "edges")
    of_edges = edges.groupBy("content", "other").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").drop("n")
    firsts = stored(of_edges, "edge-groups")
    found = stored(later(again, straight, ["inner"]).unionByName(later(edges, firsts, ["content", "other"])), "later")
    for table in (again, groups, edges, firsts):
        drop_stored(table)
    return found


def cut(text: str, covered: np.ndarray) -> str:
    """The text without the covered words and the blanks behind each of them."""
    data = text.encode("utf-8", "replace")
    begins = [match.start() for match in WORD.finditer(data)] + [len(data)]
    change = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    parts, at = [], 0
    for start, end in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        parts.append(data[at : begins[start]])
        at = begins[end]
    return b"".join([*parts, data[at:]]).decode("utf-8", "replace")


CUT = "text string, n_words bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>"
SPAN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64())])
CUT_ARROW = pa.struct([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(SPAN_ARROW))])


def cover(words: np.ndarray, places: np.ndarray, checks: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window found at one of the places."""
    start, edges = sound(Content(words), len(words), places, checks, window)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + edges + window - 1, -1)
    return np.cumsum(change)[:-1] > 0


def cut_row(value: str | None, count: int, covered: np.ndarray | None) -> dict:
    if covered is None:
        return {"text": value, "n_words": count, "n_removed": 0, "spans": []}
    ends = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).tolist()
    spans = [{"start": a, "length": b - a} for a, b in zip(ends[::2], ends[1::2], strict=True)]
    return {"text": cut(value, covered) if spans else value, "n_words": count, "n_removed": int(covered.sum()), "spans": spans}


def without_repeats(docs: DataFrame, window: int = 20, inner: int = 8, text: str = "text") -> DataFrame:
    """Cut every word that lies in a window whose words occur earlier too.

    Earlier is a smaller ``doc_id``, or an earlier start in the same document; all windows are
    judged on the input. ``text`` holds what is left, with the blanks that stood before it;
    ``n_words`` and ``n_removed`` count words, ``spans`` are the cut stretches (first word,
    number of words). All other columns stay; those of the three names are replaced.

    Texts shorter than a window, empty ones and null ones stay as they are; a null text has no
    words. A null ``doc_id`` counts as smaller than all others; texts without a number are
    documents of their own, in the order of a hash, and equal ones are one. Rows that share a ``doc_id``
    are places of one document: a window at the same start in several of them is not earlier
    in any, so repeated rows stay alike.
    """
    if not 1 <= inner <= window or window - inner + 1 >= STEP:
        raise ValueError("the inner window must be shorter than the window, by less than STEP words")
    own, places, checks, done = free_names(docs, "_id", "_places", "_checks", "_cut")
    no_number = F.lit(NO_ID) + F.xxhash64(F.col(text)).bitwiseAND(F.lit(2**61 - 1))
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("bigint"), no_number))
    texts = keyed.select(F.col(own).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = repeats(texts, window, inner)
    listed = listed_places(found).toDF(own, places, checks)

    @F.arrow_udf(CUT)
    def apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts, all_places, all_checks in batches:
            parts = [pa.array([], CUT_ARROW)]
            for first, values in text_portions(texts):
                rows = []
                for at, value in enumerate(values, first):
                    words, covered = value.encode("utf-8", "replace").split(), None
                    if all_places[at].is_valid and len(words) >= window:
                        covered = cover(hashes(words), *(np.array(column[at].as_py()) for column in (all_places, all_checks)), window)
                    rows.append(cut_row(value if texts[at].is_valid else None, len(words), covered))
                parts.append(pa.array(rows, CUT_ARROW))
            yield pa.concat_arrays(parts)

    # said to be not deterministic, so that a filter on its results does not run it a second time
    apply = apply.asNondeterministic()
    joined = keyed.join(listed, own, "left").withColumn(done, apply(F.col(text), F.col(places), F.col(checks)))
    results = {name: F.col(f"{done}.{name}") for name in ("n_words", "n_removed", "spans")}
    return joined.withColumns({text: F.col(f"{done}.text"), **results}).drop(own, places, checks, done)
