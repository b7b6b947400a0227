"""Near-duplicate groups: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Texts with equal shingle sets are one class; only classes are compared.
2. Classes whose signatures agree in a band share a bucket. Buckets of up to ``small``
   classes give pairs by a join. Larger ones are cut into blocks, each one task's work, whose
   output is no larger than its input: a forest of confirmed links. Then only classes outside
   of a bucket's largest component are compared across its blocks.
3. Signatures are compared batch by batch. A pair goes as soon as the posterior probability
   that its similarity reaches the threshold falls below ``miss``.
4. What is left is confirmed on the full shingle sets. Two classes that links connect
   already are not compared again.
5. Links are contracted to components: inside of tasks, then in rounds that are written out.

At the threshold a pair has no common band with probability (1 - 0.8 ** rows) ** bands, and
is dropped with probability of at most ``miss`` per batch; both fall fast above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import WordHashes, drop_stored, mix, seeds, stored, text_portions, window_hashes


@dataclass(frozen=True)
class Settings:
    shingle: int = 5  # words
    percent: int = 80  # similarity
    bands: int = 32
    rows: int = 4  # signature values in a band
    batch: int = 32  # signature values compared at a time
    miss: float = 1e-6
    small: int = 16  # classes in a bucket that is joined to pairs
    block: int = 512  # classes of a larger bucket in one task, or twice as many across blocks
    block_shingles: int = 4_000_000  # about so many shingles, of 8 bytes, in them; changes no result

    @property
    def length(self) -> int:
        return self.bands * self.rows


SETTINGS = Settings()


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words are one shingle, none give none."""
    words = hashes((text or "").encode("utf-8", "replace").lower().split())
    return np.unique(window_hashes(words, min(size, len(words)), len(words) if len(words) < size else 0)) if len(words) else words


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    lowest = np.full(len(factors), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(lowest, (shingles[at : at + 1024, None] * factors).min(0), out=lowest)
    return (mix(lowest) & np.uint64(0xFFFF)).astype("<u2")


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; two of 10 ** 9 different sets share one with probability 0.03."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, text_hash, n, node, sig`` of every row of ``doc_id, text_hash, text``; node and sig are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHashes(), seeds(settings.length, 5)
        for batch in batches:
            rows = []
            for text in batch.column(2):
                shingles = shingle_set(text.as_py(), settings.shingle, hashes)
                if len(shingles):
                    rows.append((len(shingles), node_of(shingles), signature(shingles, factors).tobytes()))
                else:
                    rows.append((0, None, None))
            n, node, sig = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n", "node", "sig"])

    return docs.mapInArrow(sign, "doc_id bigint, text_hash bigint, n bigint, node bigint, sig binary")


def band_keys(settings: Settings) -> Column:
    """A hash for each band of a signature, with the band's number in it."""
    size = 2 * settings.rows
    return F.array(*[F.xxhash64(F.lit(band), F.substring(F.col("sig"), 1 + size * band, size)) for band in range(settings.bands)])


def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """After so many compared values, the matches below which a pair goes.

    With a uniform prior the similarity, given m matches of n, has a Beta posterior, and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, table = settings.percent / 100, []
    for n in range(settings.batch, settings.length + 1, settings.batch):
        below, m = 0.0, -1
        while below < settings.miss:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        table.append((n, m))
    return table


def surviving(left: np.ndarray, right: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of signatures that no batch rules out, and their matches."""
    pairs, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in least_matches(settings):
        matches = matches + (left[pairs, done:n] == right[pairs, done:n]).sum(1)
        stay = matches >= least
        pairs, matches, done = pairs[stay], matches[stay], n
    return pairs, matches


def linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(other) - common)


def forest(members: pd.DataFrame, settings: Settings) -> list[tuple[int, int]]:
    """Links of roots that connect what confirmed pairs of these rows of one bucket can connect.

    Rows with ``asks`` are compared with those with ``held``; rows of one ``root`` are not, and
    two that are ``outside`` of the largest component only once.
    """
    sigs = np.stack([np.frombuffer(sig, "<u2") for sig in members["sig"]])
    sets = [np.frombuffer(shingles, "<u8") for shingles in members["shingles"]]
    n, nodes, roots, outside = (members[name].to_numpy() for name in ("n", "node", "root", "outside"))
    asks, others = (np.flatnonzero(members[name].to_numpy()) for name in ("asks", "held"))
    band = int(members["band"].iloc[0])
    parent: dict[int, int] = {}

    def top(node: int) -> int:
        while (above := parent.setdefault(node, node)) != node:
            parent[node] = parent[above]
            node = above
        return node

    found = []
    for at in asks.tolist():
        rest = others[(roots[others] != roots[at]) & (~outside[others] | (nodes[others] > nodes[at]))]
        rest = rest[100 * np.minimum(n[at], n[rest]) >= settings.percent * np.maximum(n[at], n[rest])]
        if band:  # a pair belongs to the first band in which it agrees
            width = band * settings.rows
            same = (sigs[at, :width] == sigs[rest, :width]).reshape(len(rest), band, settings.rows)
            rest = rest[~same.all(2).any(1)]
        pairs, matches = surviving(np.broadcast_to(sigs[at], (len(rest), settings.length)), sigs[rest], settings)
        found += zip(matches.tolist(), [at] * len(pairs), rest[pairs].tolist(), strict=True)
    links = []
    for _, one, other in sorted(found, reverse=True):
        tops = top(int(roots[one])), top(int(roots[other]))
        if tops[0] != tops[1] and linked(sets[one], sets[other], settings.percent):
            parent[tops[0]] = tops[1]
            links.append((int(roots[one]), int(roots[other])))
    return links


def shingle_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """``node, shingles, sig`` of the wanted ``node, key, sig``, from the texts of the rows that the keys name."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for _, texts in text_portions(batch.column(0), 2_000_000):
                sets = [shingle_set(text, settings.shingle, hashes) for text in texts]
                arrays = [pa.array([node_of(own) for own in sets], pa.int64()), pa.array([own.astype("<u8").tobytes() for own in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "shingles"])

    reps = wanted.select("key.*").toDF("no_id", "rep_id", "rep_hash")
    named = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash"))
    found = docs.join(reps, named, "left_semi").select("text").mapInArrow(find, "node bigint, shingles binary")
    sets = found.groupBy("node").agg(F.first("shingles").alias("shingles"))
    return sets.join(wanted.select("node", "sig"), "node")


def links_of(docs: DataFrame, classes: DataFrame, settings: Settings, spent: list[DataFrame]) -> DataFrame:
    """Links ``u, v`` that connect whatever confirmed pairs link; ``spent`` gets the tables it rests on."""
    at_bands = classes.select("node", "n", F.posexplode(band_keys(settings)).alias("band", "key"))
    sizes = at_bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).where("members > 1")
    # a table of its own, so that a large bucket's rows can be split among the tasks of the join
    sizes = stored(sizes, "bucket-sizes")
    shared = stored(at_bands.join(sizes, "key"), "buckets")
    spent += [sizes, shared]

    few = shared.where(F.col("members") <= settings.small).select("key", "node", "n")
    other = few.select("key", F.col("node").alias("v"), F.col("n").alias("n_v"))
    similar_size = F.lit(100) * F.least("n", "n_v") >= F.lit(settings.percent) * F.greatest("n", "n_v")
    pairs = few.join(other, "key").where((F.col("node") < F.col("v")) & similar_size).select(F.col("node").alias("u"), "v").distinct()
    sigs = classes.select("node", "sig")
    with_sigs = pairs.join(sigs.toDF("u", "sig_u"), "u").join(sigs.toDF("v", "sig_v"), "v")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                left, right = (np.stack([np.frombuffer(sig, "<u2") for sig in batch[name]]) for name in ("sig_u", "sig_v"))
                yield batch.iloc[surviving(left, right, settings)[0]][["u", "v"]]

    candidates = stored(with_sigs.mapInPandas(prune, "u bigint, v bigint"), "candidates")
    many = shared.where(F.col("members") > settings.small)
    nodes = candidates.select(F.col("u").alias("node")).union(candidates.select("v")).union(many.select("node")).distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("node", "key", "sig")
    sets = stored(shingle_sets(docs, wanted, settings), "shingle-sets")
    spent += [candidates, sets]

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [
                linked(np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8"), settings.percent)
                for one, other in zip(batch["set_u"], batch["set_v"], strict=True)
            ]
            yield batch.loc[np.array(same, bool), ["u", "v"]]

    plain = sets.select("node", "shingles")
    with_sets = candidates.join(plain.toDF("v", "set_v"), "v").join(plain.toDF("u", "set_u"), "u")
    confirmed = with_sets.mapInPandas(confirm, "u bigint, v bigint")

    def connect(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(members, settings), columns=["u", "v"]).astype("int64")

    def blocks_of(rows: Column, weight: Column) -> Column:
        return F.ceil(F.greatest(rows / F.lit(settings.block), weight / F.lit(settings.block_shingles))).cast("int")

    def block(blocks: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")

    columns = ("key", "band", "node", "n")
    inside = many.select(*columns, F.col("node").alias("root"), block(blocks_of(F.col("members"), F.col("weight")), 1).alias("block"))
    inside = inside.join(sets, "node").withColumns({name: F.lit(True) for name in ("outside", "asks", "held")})
    first = stored(
        confirmed.unionByName(inside.groupBy("key", "block").applyInPandas(connect, "u bigint, v bigint")), "first-links"
    )

    spent.append(first)
    inner = stars(first, spent)
    rooted = many.join(inner.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    largest = of_root.groupBy("key").agg(
        F.max(F.struct("rows", "root", "weight")).alias("largest"), F.sum("rows").alias("all"), F.sum("weight").alias("all_weight")
    )
    largest = stored(largest.where(F.col("largest.rows") < F.col("all")), "largest-components")
    spent.append(largest)
    spread = rooted.join(largest, "key").select(
        *columns,
        "root",
        (F.col("root") != F.col("largest.root")).alias("outside"),
        blocks_of(F.col("all"), F.col("all_weight")).alias("blocks"),
        blocks_of(F.col("all") - F.col("largest.rows"), F.col("all_weight") - F.col("largest.weight")).alias("outer_blocks"),
    )

    def numbers(blocks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks - 1))

    held = spread.withColumns({"i": block(F.col("blocks"), 1), "asks": F.lit(False), "held": F.lit(True)})
    held = held.withColumn("j", numbers(F.col("outer_blocks")))
    asks = spread.where("outside").withColumns({"j": block(F.col("outer_blocks"), 2), "asks": F.lit(True), "held": F.lit(False)})
    asks = asks.withColumn("i", numbers(F.col("blocks")))
    names = (*columns, "root", "outside", "asks", "held", "i", "j")
    across = held.select(*names).unionByName(asks.select(*names)).join(sets, "node")
    return inner.unionByName(across.groupBy("key", "i", "j").applyInPandas(connect, "u bigint, v bigint"))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links that are not the smallest of their component, and the smallest."""
    nodes, numbers = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, other = np.split(numbers, 2)
    root = np.arange(len(nodes))
    while len(one):
        low, high = np.minimum(root[one], root[other]), np.maximum(root[one], root[other])
        apart = low < high
        one, other = one[apart], other[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def contracted(links: DataFrame, portion: int) -> DataFrame:
    """``u, v``: in every portion of a task's links each node hangs on the smallest one it reaches there.

    Consecutive links of one ``u`` stay in one portion.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()) for ends in least_reached(u, v)], names=["u", "v"])

        for batch in batches:
            held.append([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            rows += len(batch)
            if rows >= portion:
                u, v = map(np.concatenate, zip(*held, strict=True))
                cut = len(u) - int(np.argmax(u[::-1] != u[-1])) if (u != u[-1]).any() else 0
                if cut:
                    yield stars(u[:cut], v[:cut])
                held, rows = [[u[cut:], v[cut:]]], len(u) - cut
        if rows:
            yield stars(*map(np.concatenate, zip(*held, strict=True)))

    return links.mapInArrow(contract, "u bigint, v bigint")


def stars(links: DataFrame, spent: list[DataFrame] | None = None, portion: int = 500_000) -> DataFrame:
    """``u, v`` of every linked node ``u`` but the smallest ``v`` of its component, from links ``u, v``.

    ``spent`` gets the table that the result is, to be dropped in time.

    Tasks contract the links they hold, before and after these are dealt by their larger node; so
    most components are stars after one shuffle. Each further round hangs all nodes on the node
    above theirs and contracts again. A node above very many is in no key of a group, only
    in a join that can be split.
    """

    def dealt(edges: DataFrame) -> DataFrame:
        return contracted(contracted(edges, portion).repartition("u").sortWithinPartitions("u"), portion)

    def settled(edges: DataFrame) -> bool:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
        ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
        roles = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
        return roles.agg(F.count_if(F.col("above") + F.col("below") > 1)).first()[0] == 0

    edges = stored(dealt(links.select("u", "v").where("u <> v")), "links")
    while not settled(edges):
        above = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("above"))
        closer = stored(dealt(edges.join(above, "v", "left").select("u", F.coalesce("above", "v").alias("v"))), "stars")
        drop_stored(edges)
        edges = closer
    if spent is not None:
        spent.append(edges)
    return edges


def components(links: DataFrame, spent: list[DataFrame] | None = None) -> DataFrame:
    """``node, root`` of every linked node; the root is the smallest node reachable.

    ``spent`` gets the table that the result rests on, to be dropped in time.
    """
    edges = stars(links, spent)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def row_key() -> Column:
    """What tells rows apart, least first: the number, a null one last, and the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")


def members(docs: DataFrame, settings: Settings = SETTINGS, text: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept, stays`` for every row of ``docs``.

    ``text_hash`` is ``xxhash64`` of the text. ``stays`` is true for one row of each group, or its
    repeated rows, the one with the smallest number and then hash, a null number last; and for all
    rows without words. The other columns are those of :func:`grouped`.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    signatures = stored(signed(texts, settings), "signatures")
    words = signatures.where("node is not null")
    of_class = words.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.min(row_key()).alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    classes = stored(of_class, "classes")
    spent: list[DataFrame] = []
    roots = components(links_of(texts, classes, settings, spent), spent)
    named = classes.select("node", "rep", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("key").alias("least_key"))
    of_node = stored(named.join(least, "root").select("node", "component_id", "least_key"), "components")
    for table in (*spent, classes):
        drop_stored(table)
    found = signatures.select("doc_id", "text_hash", "n", "node").join(of_node, "node", "left")
    stays = F.coalesce(F.col("least_key") == row_key(), F.col("node").isNull())
    component = F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("doc_id")))
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), stays.alias("stays")).select(
        "doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "stays"
    )


def grouped(docs: DataFrame, settings: Settings = SETTINGS, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked if their sets of shingles (lower-case A-Z, words between blanks) have the
    similarity or more. ``component_id`` is the smallest ``doc_id`` that links reach, its own
    included; ``kept`` is true for the row, or the repeated rows, that have this ``doc_id``. A
    text with fewer words than a shingle is one shingle; a text without words, or null, has an
    empty set, is linked with nothing and is kept. A row with a null ``doc_id`` is linked like any
    other; it names its component only if no row of it has a number, and is kept only then.
    Further columns of ``docs`` are not used.
    """
    return members(docs, settings, text).drop("text_hash", "stays")
