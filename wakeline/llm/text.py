"""What several operators share: words as columns and as bytes, 64-bit hashes, shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed: the characters between words, which are also those that bytes.split() splits at.
BLANKS = r"[\x20\x09-\x0D]+"

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: Column) -> Column:
    """The words of a text as an array; of a null none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


def seeds(count: int, start: int) -> np.ndarray:
    """Fixed odd multipliers, as many as wanted."""
    return mix(np.arange(start, start + count, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Content:
    """Hashes of any stretch of a sequence of hashed words, from running sums."""

    def __init__(self, words: np.ndarray, base: int = BASES[0]):
        power, self.back = (np.ones(len(words) + 1, np.uint64) for _ in range(2))
        np.cumprod(np.full(len(words), base, np.uint64), out=power[1:])
        np.cumprod(np.full(len(words), pow(base, -1, 2**64), np.uint64), out=self.back[1:])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))


def text_lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def text_portions(column: pa.Array, size: int = 300_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about so many bytes, with the number of the first; nulls are empty.

    Only one portion at a time is a list of Python texts, which bounds the memory of a task.
    """
    start, held = 0, 0
    lengths = text_lengths(column).tolist()
    for at, length in enumerate(lengths):
        held += length
        if held >= size or at == len(lengths) - 1:
            yield start, [text or "" for text in column.slice(start, at + 1 - start).to_pylist()]
            start, held = at + 1, 0


class WordHashes:
    """64-bit hashes of words given as bytes; remembers a bounded number of them."""

    def __init__(self, remembered: int = 60_000):
        self.remembered, self.known = remembered, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.remembered:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        for word in set(words).difference(known):
            known[word] = digest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int, start: int = 0) -> np.ndarray:
    """One 64-bit hash for each run of ``size`` hashes; ``start`` picks the hash function."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for at, factor in enumerate(seeds(size, 1000 * (start + 1))):
        total += mix(hashes[at : at + count] + factor) * factor
    return mix(total)


@cache
def own_folder() -> tempfile.TemporaryDirectory:
    """A folder of this process, which goes when it ends."""
    return tempfile.TemporaryDirectory(prefix="corpus-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in ``spark.checkpoint.dir``; only a local session may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = own_folder().name
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Spark's own setting: the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: a cut lineage that survives lost executors.

    Nothing reads the shuffles of the written rows again, so their files go at once.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop_stored(table: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` returned and that no result reads any more."""
    spark = table.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
