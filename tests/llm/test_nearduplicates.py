import random

import pytest
from corpus import AWKWARD, clashing, corpus, frame, words

from wakeline.llm import nearduplicates
from wakeline.llm.nearduplicates import Settings


def sets_by_hand(rows, size):
    sets = []
    for doc_id, text, *_ in rows:
        own = (text or "").encode().lower().split()
        grams = {tuple(own[at : at + size]) for at in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()
        sets.append((doc_id, grams))
    return sets


def by_hand(rows, size):
    sets = sets_by_hand(rows, size)
    parent = list(range(len(sets)))

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for a in range(len(sets)):
        for b in range(a):
            one, other = sets[a][1], sets[b][1]
            if one and other and 100 * len(one & other) >= 80 * len(one | other):
                parent[root(a)] = root(b)
    least = {}
    for at, (doc_id, grams) in enumerate(sets):
        least[root(at)] = min(least.get(root(at), doc_id), doc_id)
    return sorted((doc_id, len(grams), least[root(at)], least[root(at)] == doc_id) for at, (doc_id, grams) in enumerate(sets))


def found(spark, rows, **settings):
    return sorted(tuple(row) for row in nearduplicates.grouped(frame(spark, rows), Settings(**settings)).collect())


def near_copies(count, seed=3):
    """Copies of one text with one to eight changed words, so that many pairs lie near the threshold."""
    draw, base = random.Random(seed), words(11, 120, 10**6)
    rows = []
    for n in range(count):
        own = list(base)
        for _ in range(draw.randrange(0, 9)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        rows.append((n, " ".join(own), "en", "a", 0))
    return rows


@pytest.mark.parametrize("shingle", [4, 5])
def test_groups_equal_brute_force(spark, shingle):
    rows = [row for row in corpus(2, 80) if row[0] is not None]
    assert found(spark, rows, shingle=shingle) == by_hand(rows, shingle)


@pytest.mark.parametrize("settings", [{}, {"small": 2}, {"small": 2, "block": 20}, {"small": 10**6}])
def test_a_large_group_equals_brute_force_in_every_way(spark, settings):
    rows = near_copies(120) + [(10_000 + n, "Same Text Of Copies here " * 3, "en", "a", 0) for n in range(100)]
    assert found(spark, rows, shingle=4, **settings) == by_hand(rows, 4)


def test_a_chain_of_links_is_one_group(spark):
    base, rows = words(5, 100, 10**6), []
    for n in range(30):
        base[(3 * n) % 100] = f"step{n}"
        rows.append((100 - n, " ".join(base), "en", "a", 0))
    result = found(spark, rows)
    assert result == by_hand(rows, 5) and {row[2] for row in result} == {71}


def test_components_of_any_graph(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000, n) for n in range(1001, 1200)]
    rows = nearduplicates.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    root = {n: n for edge in edges for n in edge}
    for _ in range(300):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    linked = {n for u, v in edges if u != v for n in (u, v)}
    assert {row["node"]: row["root"] for row in rows} == {n: root[n] for n in linked}
    assert len(rows) == len(linked)


def written(spark, monkeypatch, edges):
    """The components of these edges, and how many tables were written for them."""
    tables = []
    monkeypatch.setattr(nearduplicates, "stored", lambda df, name, f=nearduplicates.stored: (tables.append(name), f(df, name))[1])
    rows = nearduplicates.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    return {row["node"]: row["root"] for row in rows}, tables


def test_links_of_many_bands_need_few_rounds(spark, monkeypatch):
    draw = random.Random(2)
    edges = [(n, draw.randrange(n)) for _ in range(16) for n in range(1, 400)]
    found, tables = written(spark, monkeypatch, edges)
    assert found == dict.fromkeys(range(400), 0)
    assert len(tables) <= 2


@pytest.mark.parametrize("portion", [1, 7, 10**6])
def test_portions_and_a_long_chain_are_contracted(spark, portion):
    nodes = list(range(-60, 60))
    random.Random(4).shuffle(nodes)
    edges = [*zip(nodes, nodes[1:]), *zip(nodes, nodes[1:]), (500, 400), (400, 500), (300, 300)]
    rows = nearduplicates.stars(spark.createDataFrame(edges, "u bigint, v bigint"), portion=portion).collect()
    assert sorted(tuple(row) for row in rows) == [*((n, -60) for n in range(-59, 60)), (500, 400)]


def test_posterior_bounds():
    table = nearduplicates.least_matches(Settings())
    assert [n for n, _ in table] == [32, 64, 96, 128]
    assert all(m < 0.8 * n for n, m in table) and table[-1][1] > 60


def test_null_numbers_repeats_and_other_columns(spark):
    df = clashing(frame(spark, AWKWARD), "n", "node", "sig", "key", "component_id")
    rows = {(row["doc_id"], row["n_shingles"]): row for row in nearduplicates.grouped(df).collect()}
    assert rows[(5, 1)]["component_id"] == 4 and not rows[(5, 1)]["kept"] and rows[(4, 1)]["kept"]
    assert all(rows[(n, 0)]["component_id"] == n and rows[(n, 0)]["kept"] for n in (1, 2, 3))
    assert rows[(None, 1)]["component_id"] is None and rows[(None, 1)]["kept"]
    assert nearduplicates.grouped(df).count() == len(AWKWARD)
    assert nearduplicates.grouped(df.limit(0)).count() == 0


def test_rows_without_a_number_are_linked_like_others(spark):
    base, bridge = words(21, 100, 10**6), words(22, 10, 10**6)
    middle, far = base[:90] + bridge, base[10:90] + bridge + words(23, 10, 10**6)
    rows = [(5, " ".join(far), "en", "a", 0), (8, " ".join(base), "en", "a", 0), (None, " ".join(middle), "en", "a", 0)]
    rows += [(None, " ".join(base), "en", "a", 0), (None, " ".join([*words(24, 50, 10**6)]), "en", "a", 0)] * 2
    alone, linked = (nearduplicates.grouped(frame(spark, part), Settings(shingle=1)).collect() for part in (rows[:2], rows))
    assert {row["doc_id"]: row["component_id"] for row in alone} == {5: 5, 8: 8}
    assert sorted((row["doc_id"] or 0, row["component_id"] or 0, row["kept"]) for row in linked) == [
        (0, 0, True), (0, 0, True), (0, 5, False), (0, 5, False), (0, 5, False), (5, 5, True), (8, 5, False)
    ]
    stays = nearduplicates.members(frame(spark, rows), Settings(shingle=1)).where("stays").collect()
    assert sorted((row["doc_id"] or 0, row["component_id"] or 0) for row in stays) == [(0, 0), (0, 0), (5, 5)]


def test_blocks_by_bytes_change_nothing(spark):
    rows = near_copies(60)
    assert found(spark, rows, shingle=4, small=2, block_shingles=700) == by_hand(rows, 4)
