"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items that share a window of ``min_match`` tokens are joined on it; the
window of a shorter item is the whole item. An item's most frequent windows, as many as cover less
than the threshold together, join nothing: a text that shares no other one stays below it anyway. So
a phrase that stands in many texts and many items does not pair them all, and no pair is lost.
All shared windows of the pairs bound what a tiling can cover, so pairs below the threshold go
before any text is compared. For the others the longest matches of yet unmarked tokens are marked again
and again, found by running Karp-Rabin hashes, until none of ``min_match`` tokens is left.
Tiles may lie in any order, so reordered passages are found like straight ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import Content, WordHashes, drop_stored, stored, text_portions

# Fixed: scripts written without blanks between words (South-East Asian ones, Yi, kana, Han).
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
)
UNSPACED_LETTER = re.compile(rf"(?=[{UNSPACED}])[^\W_]")
# A token is a letter of such a script, or a run of other letters and digits.
TOKEN = re.compile(rf"[^\W_{UNSPACED}]+|{UNSPACED_LETTER.pattern}")
RUN = re.compile(r"[^\W_]+")
TILE = "array<struct<doc_token:bigint,item_token:bigint,length:bigint>>"
# The seeds of the benchmark are sent to all executors up to this many (12 bytes each).
MAX_SENT_SEEDS = 1_000_000
# So are the items of the pairs left, up to this many bytes of item texts; beyond, the texts are shuffled to them.
MAX_SENT_BYTES = 32 << 20


# The same tokens of a text of ASCII characters, by a table of its bytes.
ASCII = bytes(at if chr(at).isalnum() and at < 128 else 32 for at in range(256))


def tokens_of(text: str) -> list[str]:
    text = text.lower()
    return (TOKEN if UNSPACED_LETTER.search(text) else RUN).findall(text)


def token_hashes(text: str, hashes: WordHashes) -> np.ndarray:
    """Hashes of :func:`tokens_of`; those of a text and of its UTF-8 bytes are the same."""
    if text.isascii():
        return hashes(text.lower().encode().translate(ASCII).split())
    return hashes(tokens_of(text))


def powers(base: int, count: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(count - 1, 0), base, np.uint64))]).astype(np.uint64)


class RunningHashes:
    """Karp-Rabin hashes of all windows of any length of one token sequence."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, tokens: np.ndarray):
        self.power = powers(self.BASE, len(tokens) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * self.power[: len(tokens)], dtype=np.uint64)])

    def windows(self, length: int, last_power: np.ndarray) -> np.ndarray:
        """Equal windows of two sequences have equal hashes, if both get the longer one's powers."""
        count = len(self.sums) - length
        if count <= 0:
            return np.empty(0, np.uint64)
        return (self.sums[length:] - self.sums[:count]) * last_power[::-1][:count]


def free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    taken = np.concatenate([[0], np.cumsum(marked)])
    return taken[length:] == taken[:-length]


def longest_matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, least: int, size: int, sums, power):
    """All matches of the greatest length of at least ``least`` unmarked tokens, as (length, pairs)."""
    size = max(least, size)
    while True:
        of_doc, of_item = sums[0].windows(size, power), sums[1].windows(size, power)
        at_doc, at_item = np.flatnonzero(free_windows(~free_doc, size)), np.flatnonzero(free_windows(~free_item, size))
        order = at_item[np.argsort(of_item[at_item], kind="stable")]
        low = np.searchsorted(of_item[order], of_doc[at_doc], "left")
        high = np.searchsorted(of_item[order], of_doc[at_doc], "right")
        hits = np.flatnonzero(high > low)
        best, pairs = 0, []
        for hit in hits.tolist():
            start = int(at_doc[hit])
            for other in order[low[hit] : high[hit]].tolist():
                length = 0
                while (
                    start + length < len(doc)
                    and other + length < len(item)
                    and free_doc[start + length]
                    and free_item[other + length]
                    and doc[start + length] == item[other + length]
                ):
                    length += 1
                if length > best:
                    best, pairs = length, []
                if length == best and length >= least:
                    pairs.append((other, start))
        if pairs:
            return best, sorted(pairs)
        if size == least:
            return 0, []
        size = max(least, size // 2)


def tiling(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length): always the longest, first in the item, then in the doc."""
    free_doc, free_item, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    sums = RunningHashes(doc), RunningHashes(item)
    power = powers(RunningHashes.BASE, max(len(doc), len(item)) + 1)
    size = min(len(doc), len(item))
    while size >= least:
        size, pairs = longest_matches(doc, item, free_doc, free_item, least, size, sums, power)
        for other, start in pairs:
            if free_doc[start : start + size].all() and free_item[other : other + size].all():
                free_doc[start : start + size] = False
                free_item[other : other + size] = False
                tiles.append((start, other, size))
    return tiles


def document_seeds(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``text_hash, seed`` of each window of so many tokens; ``docs`` has ``text_hash`` and ``text``."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            prints = batch.column(0)
            for first, texts in text_portions(batch.column(1)):
                tokens = [token_hashes(text, hashes) for text in texts]
                ends = np.cumsum([len(own) for own in tokens])
                joined = np.concatenate(tokens)
                text = np.repeat(np.arange(len(tokens)), [len(own) for own in tokens])
                content, left = Content(joined), ends[text] - np.arange(len(joined))
                for length in lengths:
                    starts = np.flatnonzero(left >= length)
                    rows = pa.array(text[starts] + first)
                    windows = pa.array(content(starts, length).view(np.int64))
                    yield pa.RecordBatch.from_arrays([prints.take(rows), windows], names=["text_hash", "seed"])

    return docs.mapInArrow(seeds, "text_hash bigint, seed bigint")


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """``item_hash, tokens, place, seed`` for each window of each item; a shorter item is one window."""

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for item_hash, text in zip(batch["item_hash"], batch["item_text"], strict=True):
                tokens = token_hashes(text, hashes)
                length = min(least, len(tokens))
                starts = np.arange(len(tokens) - length + 1 if length else 0)
                windows = Content(tokens)(starts, length).view(np.int64)
                yield pd.DataFrame({"item_hash": item_hash, "tokens": len(tokens), "place": np.arange(len(windows)), "seed": windows})

    return items.mapInPandas(seeds, "item_hash bigint, tokens bigint, place bigint, seed bigint")


def telling_places(texts: list[int], places: list[int], tokens: int, least: int, threshold: float) -> list[int]:
    """Numbers of the windows, rarest ones, of which a pair that reaches the threshold shares at least one.

    ``texts`` counts the texts with each window. The windows left out, the most frequent ones, cover
    less than ``threshold`` of the item's tokens together. Windows that no text has are not listed.
    """
    covered, count = np.zeros(tokens, bool), 0
    order = sorted(range(len(places)), key=lambda n: (-texts[n], places[n]))
    for at, n in enumerate(order):
        window = covered[places[n] : places[n] + least]
        count += len(window) - int(window.sum())
        if count >= threshold * tokens:
            return [other for other in order[at:] if texts[other]]
        window[:] = True
    return []


def telling_seeds(counted: DataFrame, least: int, threshold: float) -> DataFrame:
    """``item_hash, seed`` of :func:`telling_places`; an item's windows meet in a task."""
    window = F.struct(F.coalesce("texts", F.lit(0).cast("bigint")).alias("texts"), "place", "seed")

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item_hash, tokens, windows in batch.itertuples(index=False):
                texts, places = [one["texts"] for one in windows], [one["place"] for one in windows]
                rows += [(item_hash, windows[n]["seed"]) for n in telling_places(texts, places, tokens, least, threshold)]
            yield pd.DataFrame(rows, columns=["item_hash", "seed"]).astype("int64")

    of_items = counted.groupBy("item_hash", "tokens").agg(F.collect_list(window).alias("windows"))
    return of_items.mapInPandas(chosen, "item_hash bigint, seed bigint").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_match: int = 5) -> DataFrame:
    """Pairs of a document and a benchmark item of whose tokens it has at least the threshold.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; further columns
    are not used. Returns ``doc_id, item_id, coverage, matched, item_tokens, tiles`` and the
    ``text_hash`` of the document, which tells texts with one number apart; a repeated row of
    number and text gives one result. Tokens are lower-case runs of letters and digits, and single
    letters of scripts without blanks. A null text has none; an item of fewer than ``min_match``
    tokens has to stand as a whole. Null numbers stay null. An empty table on either side gives
    no row.
    """
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.xxhash64("text").alias("item_hash"), F.col("text").alias("item_text"))
    items = items.where("item_text is not null").distinct()
    of_items = item_seeds(items.select("item_hash", "item_text").distinct(), min_match)
    length = F.least(F.col("tokens"), F.lit(min_match).cast("bigint"))
    # at most min_match rows
    sizes = {row["length"]: row["count"] for row in of_items.groupBy(length.alias("length")).count().collect()}
    few = sum(sizes.values()) <= MAX_SENT_SEEDS

    def sent(seeds: DataFrame) -> DataFrame:
        return F.broadcast(seeds) if few else seeds

    wanted = of_items.select("seed").distinct()
    found = document_seeds(read.select("text_hash", "text"), sorted(sizes)).join(sent(wanted), "seed", "left_semi")
    hits = stored(found.select("text_hash", "seed").distinct(), "shared-seeds")
    frequent = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("texts"))
    telling = telling_seeds(of_items.join(sent(frequent), "seed", "left"), min_match, threshold)
    candidates = hits.join(sent(telling), "seed").select("text_hash", "item_hash").distinct()
    covered = F.flatten(F.transform(F.collect_set("place"), lambda at: F.sequence(at, at + F.lit(min_match - 1))))
    bounded = (
        candidates.join(sent(of_items), "item_hash")
        .join(hits, ["text_hash", "seed"])
        .groupBy("text_hash", "item_hash", "tokens")
        .agg(F.size(F.array_distinct(covered)).alias("bound"))
        .where(F.col("bound") >= F.lit(threshold) * F.col("tokens"))
    )
    pairs = stored(bounded.select(F.col("text_hash").alias("pair_hash"), "item_hash"), "pairs")
    drop_stored(hits)
    of_pairs = pairs.join(items, "item_hash")
    size = of_pairs.agg(F.sum(F.octet_length("item_text") + 16).alias("bytes")).first()["bytes"] or 0
    with_items = of_pairs.groupBy("pair_hash").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    to_tile = F.broadcast(with_items) if size <= MAX_SENT_BYTES else with_items
    texts = read.join(to_tile, F.col("text_hash") == F.col("pair_hash")).select("doc_id", "text_hash", "text", "items")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, text_hash, text, items in batch.itertuples(index=False):
                doc = token_hashes(text, hashes)
                for item in items:
                    tokens = token_hashes(item["item_text"], hashes)
                    tiles = tiling(doc, tokens, min(min_match, len(tokens)))
                    matched = sum(length for _, _, length in tiles)
                    if matched >= threshold * len(tokens):
                        places = [{"doc_token": a, "item_token": b, "length": n} for a, b, n in tiles]
                        rows.append((doc_id, text_hash, item["item_id"], matched / len(tokens), matched, len(tokens), places))
            names = ["doc_id", "text_hash", "item_id", "coverage", "matched", "item_tokens", "tiles"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

    found = texts.mapInPandas(
        tile, f"doc_id bigint, text_hash bigint, item_id bigint, coverage double, matched bigint, item_tokens bigint, tiles {TILE}"
    )
    return found.distinct()
