import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from corpus import clashing
from pyspark.sql import functions as F

from wakeline.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
CHARACTER = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def best(turns):
    """Cost, letters and lines of the cheapest repair of (role, text, fault), by trying everything."""

    @cache
    def rest(at, last, inserts):
        found = []
        if at == len(turns) and (last == "a" or last == ""):
            found.append((0, "", ()))
        options = ["a"] if last == "u" else ["u"]
        if inserts < 2:
            for initial in options:
                cost, letters, lines = rest(at, initial, inserts + 1)
                found.append((5 + cost, "I" + letters, (repair.ROLES[initial] + ":", *lines)))
        if at < len(turns):
            role, text, fault = turns[at]
            cost, letters, lines = rest(at + 1, last, 0)
            found.append((2 + cost, "D" + letters, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for letter, price, own in [("K", 0, role)] + [("R", 1, repair.ROLES[initial]) for initial in "ua"]:
                    if own[:1] in options or (last == "" and own[:1] == "s"):
                        cost, letters, lines = rest(at + 1, own[:1], 0)
                        found.append((price + more + cost, letter + letters, (f"{own}:{text}", *lines)))
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def plain(rows):
    """The contract of the query, row by row."""
    held, ids = defaultdict(list), {row[0] for row in rows}
    for conv_id, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = []
    for conv_id in ids:
        turns, marked, seen = sorted(held[conv_id], key=lambda row: (row[0] is not None, row[0] or 0, *row[1:])), [], set()
        for _, role, text in turns:
            characters = CHARACTER.findall(text)
            fault = "blank" if not characters else "duplicate" if (role, text) in seen else "" if characters[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = {row[0] for row in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        counts = [sum(fault == name for *_, fault in marked) for name in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        cost, audit, lines = best(tuple(marked))
        assert LEGAL.fullmatch("".join(line[0] for line in lines))
        found.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def conversations(seed=5, count=60):
    draw, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Yes.  \n", None, "a b", "naïve.", "ß…"]
    for conv in range(count):
        for turn in range(draw.randrange(0, 9)):
            number = draw.choice([turn, turn, turn, turn + 1, None, 2 * turn])
            text = draw.choice(texts) if draw.random() < 0.5 else f"Text {draw.randrange(99)}."
            rows.append((conv if conv else None, number, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows + rows[:3]


def test_query_equals_plain_version(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, queries.op13_conversation_repair(spark, str(tmp_path)).collect()), key=repr) == plain(rows)


def test_runs_cost_what_single_turns_cost():
    draw = random.Random(1)
    for _ in range(400):
        symbols = "".join(draw.choice("xsuaoSUAO") * draw.randrange(1, 6) for _ in range(draw.randrange(0, 5)))[:12]
        runs = [(match.group()[0], len(match.group())) for match in re.finditer(r"(.)\1*", symbols)]
        role = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
        fault = {True: "truncated", False: ""}
        turns = tuple((role[one.lower()], "t", "blank" if one == "x" else fault[one.isupper()]) for one in symbols)
        cost, audit, _ = best(turns)
        assert repair.cheapest(runs) == (cost, audit)


def test_long_runs():
    cost, audit = repair.cheapest([("s", 1), ("u", 100_001), ("A", 3), ("x", 50_000)])
    assert len(audit) - audit.count("I") == 150_005
    singles = repair.END
    for symbol, length in [("x", 50_000), ("A", 3), ("u", 100_001), ("s", 1)]:
        for _ in range(length):
            singles = repair.through(repair.power(symbol, 0), singles)
    assert singles[repair.START] == cost
    price = {"D": 2, "I": 5, "R": 1, "K": 0}
    given = iter("s" + "u" * 100_001 + "AAA" + "x" * 50_000)
    total = sum(price[letter] + (5 if letter != "I" and next(given) == "A" and letter in "KR" else 0) for letter in audit)
    assert total == cost


def test_one_conversation_with_many_turns(spark):
    rows = [(1, n, "user" if n % 3 else "assistant", f"Text {n}.") for n in range(3000)]
    audits, turns = repair.repaired(spark.createDataFrame(rows, SCHEMA).repartition(6))
    audit = audits.collect()[0]
    cost, letters, _ = 0, "", None
    runs = [(match.group()[0], len(match.group())) for match in re.finditer(r"(.)\1*", "".join("u" if n % 3 else "a" for n in range(3000)))]
    cost, letters = repair.cheapest(runs)
    assert (audit["cost"], audit["audit"], audit["turns"]) == (cost, letters, 3000)
    out = turns.orderBy("place").collect()
    assert LEGAL.fullmatch("".join(row["role"][0] for row in out)) and len(out) == len(letters) - letters.count("D")
    digest = repair.digests(turns.select("tree", "place", F.concat("role", F.lit(":"), "text").alias("line"))).collect()
    whole = "\n".join(f"{row['role']}:{row['text']}" for row in out)
    assert [row["sha256"] for row in digest] == [hashlib.sha256(whole.encode()).hexdigest()]


def test_empty_tables_and_other_columns(spark, tmp_path):
    rows = spark.createDataFrame(conversations(count=12), SCHEMA)
    audits, turns = repair.repaired(clashing(rows, "tree", "at", "print", "turns", "symbol", "place", "edit"))
    plain_audits, plain_turns = repair.repaired(rows)
    assert sorted(map(str, audits.collect())) == sorted(map(str, plain_audits.collect()))
    assert sorted(map(str, turns.collect())) == sorted(map(str, plain_turns.collect()))
    audits, turns = repair.repaired(rows.limit(0))
    assert audits.collect() == [] and turns.collect() == []
    rows.limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_repair(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("symbols,audit", [("", ""), ("ua", "KK"), ("s", "D"), ("suaua", "KKKKK"), ("a", "D"), ("uu", "KR"), ("x", "D")])
def test_small_cases(symbols, audit):
    assert repair.cheapest([(symbol, 1) for symbol in symbols])[1] == audit
