"""Packing by powers of two: each document falls into pieces of binary lengths.

A document of n tokens gives n // longest pieces of the longest length and then one piece
for each bit of the rest, from the highest down. A piece is a sequence of its own, so no
sequence crosses documents and none is padded. Rows are split where they are read, without a
shuffle; sequences of equal length form a bucket, and :func:`batched` fills batches from each.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.ranks import free_names, ranked
from wakeline.llm.text import text_portions

PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + at): byte for at, byte in enumerate(others)}


class Tokens:
    """Token ids of a byte-level vocabulary file, as little-endian unsigned 32-bit numbers.

    No token of the split pattern crosses a single space or line feed between two other
    characters, so the stretches between them are looked up in a bounded memory of those met
    before. A text with other white space in a row is encoded as a whole. The file's added tokens
    are cut out of a text first, the longest one at each place, and give their own ids.
    """

    def __init__(self, path: str, pattern: str, remembered: int = 100_000):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, added = byte_letters(), content.get("added_tokens", ())
        if any(token.get(flag) for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on the text around them are not supported")
        self.added = {token["content"]: token["id"].to_bytes(4, "little") for token in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("|".join(map(re.escape, longest_first))) if added else None
        ranks = {
            bytes(letters[letter] for letter in token): number
            for token, number in content["model"]["vocab"].items()
            if token not in self.added
        }
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def encoded(self, text: str) -> bytes:
        ids = array("I", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str) -> bytes:
        if self.cuts is None or not self.cuts.search(text):
            return self.plain(text)
        ids, at = [], 0
        for match in self.cuts.finditer(text):
            ids += [self.plain(text[at : match.start()]), self.added[match.group()]]
            at = match.end()
        return b"".join([*ids, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        if re.search(r"\s\s|\0", text) or text[:1].isspace() or text[-1:].isspace():
            return self.encoded(text)
        stretches = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        missing = set(stretches).difference(self.known)
        if len(self.known) + len(missing) > self.remembered:
            self.known.clear()
            missing = set(stretches)
        for stretch in missing:
            self.known[stretch] = self.encoded(stretch)
        return b"".join(map(self.known.__getitem__, stretches))


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """Lengths that sum to ``tokens``: the longest as often as it fits, then the bits of the rest."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << bit for bit in reversed(range(longest.bit_length())) if rest >> bit & 1]


def packed(docs: DataFrame, path: str, pattern: str, longest: int = 2048, end: int = 1, text: str = "text") -> DataFrame:
    """One row for each piece: its document, place, token ids, and the sequence that it fills.

    ``ids`` are little-endian unsigned 32-bit numbers, ``longest`` is a power of two, ``end``
    closes every document. A null text counts as empty and gives the one piece ``end``.
    Repeated rows give pieces of their own. ``bucket`` is the binary logarithm of the length.
    The vocabulary file has to be at ``path`` on every executor.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    last = end.to_bytes(4, "little")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path, pattern)
        for batch in batches:
            for first, texts in text_portions(batch.column(1), 2_000_000):
                rows = []
                for at, text in enumerate(texts, first):
                    ids, start = (tokens(text) if text else b"") + last, 0
                    for length in piece_lengths(len(ids) // 4, longest):
                        rows.append((at, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4))
                        start += length
                at, *columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *arrays], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(split, PIECE).withColumns(
        {
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("bigint"),
            "bucket": F.log2(F.col("length").cast("double")).cast("int"),
        }
    )


BUCKET_BITS = 6  # of a sequence number, for the bucket it belongs to


def batched(pieces: DataFrame, batch_tokens: int = 65_536) -> DataFrame:
    """The pieces of each bucket in full batches of ``batch_tokens``; only a bucket's last may hold less.

    Adds ``batch``, from 0 in each bucket, and ``slot``, the place in the batch; all sequences of a
    batch have the same length. ``sequence_id`` becomes the number of a sequence in its bucket and the
    bucket, so that reruns agree. Pieces stand by document, null ones first, and place; those of
    repeated rows keep all their numbers. A piece longer than a batch is one of its own. Columns
    named ``batch``, ``slot`` or ``sequence_id`` are replaced, others stay, and empty tables stay empty.

    A bucket with most of the pieces is split by ranges. ``pieces`` is read twice, so it should be a
    written table; with ``ids`` in it they are shuffled too, without them only their numbers.
    """
    if batch_tokens < 1 or batch_tokens & (batch_tokens - 1):
        raise ValueError("batch_tokens must be a power of two")
    rows = pieces.drop("batch", "slot", "sequence_id")
    number, count = free_names(rows, "number", "count")
    each = F.greatest(F.lit(1), F.lit(batch_tokens).cast("bigint") / F.col("length")).cast("bigint")
    numbered = ranked(rows, "bucket", [F.col("doc_id"), F.col("start")], number, count).withColumns(
        {
            "batch": F.floor(F.col(number) / each),
            "slot": F.col(number) % each,
            "sequence_id": F.shiftleft(F.col(number), BUCKET_BITS) + F.col("bucket"),
        }
    )
    return numbered.select(*rows.columns, "sequence_id", "batch", "slot")
