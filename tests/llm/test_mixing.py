import re
from collections import defaultdict
from dataclasses import replace

import pytest
from corpus import AWKWARD, clashing, corpus, frame, words

from wakeline.llm import mixing, queries, ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = replace(mixing.CURRICULUM, slot_rows=3)


def sources(seed=3):
    """Sources of very different sizes, one with most rows, repeated rows and awkward ones."""
    rows = [(10_000 + n, " ".join(words(seed * 1000 + n, 1 + n % 50)), "en", "hot", 0) for n in range(150)]
    rows += [(500 + n, " ".join(words(n, 40)), "en", f"s{n % 7}", 0) for n in range(40)]
    rows += [(900, "long " * 3000, "en", "s0", 0), (901, "same row", "en", "twin", 0)] + [(901, "same row", "en", "twin", 0)] * 4
    return rows + corpus(size=10) + AWKWARD + [(None, "without a source", "en", None, 0)] * 2


def targets(rows, share=1.5, repeats=2, weights=(5, 2, 1)):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda source: (source is None, source or ""))
    weight = {source: weights[at % 3] for at, source in enumerate(order)}
    target, goal, still = {}, share * sum(sizes.values()), set(sizes)
    while still:
        level = (goal - sum(target.values())) / sum(weight[source] for source in still)
        full = {source for source in still if level * weight[source] >= repeats * sizes[source]}
        target |= {source: repeats * sizes[source] for source in full}
        still -= full
        if not full:
            target |= {source: level * weight[source] for source in still}
            break
    return sizes, target


def test_query_meets_its_targets(spark, tmp_path):
    rows = sources()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_curriculum_mix(spark, str(tmp_path)).collect()
    sizes, target = targets(rows)
    source_of = {row[0]: row[3] for row in rows if row[0] is not None}
    assert sorted((r["doc_id"], r["size"]) for r in found if r["doc_id"] is not None) == sorted(
        (row[0], len(WORD.findall(row[1] or ""))) for row in rows if row[0] is not None
    )
    assert len(found) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = defaultdict(int)
    for r in found:
        if r["doc_id"] is not None:
            source = source_of[r["doc_id"]]
            assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
            taken[source] += r["taken"]
    for source in set(source_of.values()) - {None, "a"}:
        assert abs(taken[source] - target[source]) <= 0.5
    assert sum(r["taken"] for r in found) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_slots_partitions_and_repeated_runs_change_nothing(spark):
    rows = sources()
    runs = [
        mixing.mixed(frame(spark, rows), replace(mixing.CURRICULUM, slot_rows=size)).collect()
        for size in (1, 3, 10**6)
    ] + [mixing.mixed(frame(spark, rows[::-1]).repartition(5), SMALL).collect()]
    assert all(sorted(map(str, run)) == sorted(map(str, runs[0])) for run in runs)


def test_positions_follow_the_integrated_schedules(spark):
    found = mixing.mixed(frame(spark, sources()), SMALL).collect()
    placed = [row["position"] for row in found if row["position"] is not None]
    assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] <= 1
    assert [row["position"] for row in found[len(placed) :]] == [None] * (len(found) - len(placed))
    order = sorted({row[3] for row in sources()}, key=lambda source: (source is None, source or ""))
    for turn, source in enumerate(order):
        schedule, times = SMALL.schedules[turn % 3], SMALL.times
        own = [row for row in found if row["source"] == source and row["position"] is not None]
        done, demand = 0, int(own[0]["target"] + 0.5) if own else 0
        for row in own:
            at, reached = row["position"], 0.0
            for low, high, a, b in zip(times, times[1:], schedule, schedule[1:], strict=False):
                end = min(max(at, low), high)
                reached += (a + a + (b - a) * (end - low) / (high - low)) / 2 * (end - low)
            assert reached / SMALL.weights[turn % 3] == pytest.approx((done + row["taken"] / 2) / demand, abs=1e-9)
            done += row["taken"]


def test_more_words_than_all_copies_hold(spark):
    found = mixing.mixed(frame(spark, sources()), replace(SMALL, share=9.0)).collect()
    assert all(row["doc_taken"] == 2 * row["size"] and row["target"] == 2 * row["source_size"] for row in found)


def test_empty_tables_and_other_columns(spark):
    docs = clashing(frame(spark, sources()), "size", "tree", "slot", "draw", "copy", "position", "target", "rows")
    assert sorted(map(str, mixing.mixed(docs).collect())) == sorted(map(str, mixing.mixed(frame(spark, sources())).collect()))
    assert mixing.mixed(frame(spark, [])).collect() == []
    assert mixing.mixed(frame(spark, [(1, None, "en", None, 0), (2, "", "en", "a", 0)])).where("doc_taken = 0 and position is null").count() == 2


def test_the_whole_plan_is_built_in(spark, monkeypatch):
    for module in (mixing, ranks):
        monkeypatch.setattr(module, "stored", lambda df, name: df)
    monkeypatch.setattr(mixing, "drop_stored", lambda df: None)
    plan = mixing.mixed(frame(spark, sources()))._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
