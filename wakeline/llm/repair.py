"""Repair of conversation structure by a run-length dynamic program.

A turn is one symbol: the initial of its role and its fault. Turns are numbered over ranges, and
equal symbols in a row collapse to a run by a join of each turn with the one before. What a
conversation still costs from a state on is a vector of four numbers; a turn is a min-plus
matrix, and a run of n turns takes the vector through the matrix's binary powers, which are
cached. The edits of a run are then unrolled by halves of these powers, the least letter first.

Whatever depends on the texts is a join by conversation and turn number, so a conversation with
very many turns is spread over tasks; only its runs and its letters, one for each edit, come
together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.ranks import ranked
from wakeline.llm.text import stored

WORD_CHARACTER = r"[^\x20\x09-\x0D]"
# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
FAR = 10**15

# States: nothing yet, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
EMITTED = {USER: "u", ASSISTANT: "a"}
END = (0, 2 * INSERT, INSERT, 0)  # a conversation is empty or ends after an assistant's turn
Vector = tuple[int, int, int, int]


def kept_state(symbol: str, state: int) -> int | None:
    """Where a turn that keeps its role leads to, if it may stand there."""
    initial = symbol.lower()
    if initial == "s":
        return SYSTEM if state == START else None
    after = NEXT[state]
    return after if EMITTED[after] == initial else None


def row_edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a turn; ``x`` has to go."""
    edits = [("D", DELETE, state)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        kept = kept_state(symbol, state)
        if kept is not None:
            edits.append(("K", more, kept))
        edits.append(("R", REROLE + more, NEXT[state]))
    return edits


def inserted(vector: list[int]) -> Vector:
    """The costs if turns may be inserted first; two are enough."""
    once = [min(vector[state], INSERT + vector[NEXT[state]]) for state in range(4)]
    return tuple(min(once[state], INSERT + once[NEXT[state]]) for state in range(4))


def through(matrix: tuple[Vector, ...], vector: Vector) -> Vector:
    return tuple(min(step + left for step, left in zip(row, vector, strict=True)) for row in matrix)


@lru_cache(maxsize=None)  # symbols x binary lengths
def power(symbol: str, exponent: int) -> tuple[Vector, ...]:
    """The min-plus matrix of ``2 ** exponent`` turns of one symbol."""
    if exponent:
        half = power(symbol, exponent - 1)
        columns = [through(half, tuple(row[to] for row in half)) for to in range(4)]
        return tuple(tuple(column[state] for column in columns) for state in range(4))
    columns = []
    for to in range(4):
        costs = [min([cost for _, cost, after in row_edits(symbol, state) if after == to], default=FAR) for state in range(4)]
        columns.append(inserted(costs))
    return tuple(tuple(column[state] for column in columns) for state in range(4))


def unrolled(symbol: str, exponent: int, state: int, left: Vector) -> tuple[str, int]:
    """The least letters among the cheapest edits of ``2 ** exponent`` turns, and the state behind them."""
    least = min(left)
    relative = tuple(cost - least for cost in left)
    return (remembered if exponent <= 10 else unroll)(symbol, exponent, state, relative)


def unroll(symbol: str, exponent: int, state: int, left: Vector) -> tuple[str, int]:
    if exponent:
        letters, state = unrolled(symbol, exponent - 1, state, through(power(symbol, exponent - 1), left))
        more, state = unrolled(symbol, exponent - 1, state, left)
        return letters + more, state
    before, letters = through(power(symbol, 0), left), ""
    while True:
        choices = [(letter, after) for letter, cost, after in row_edits(symbol, state) if cost + left[after] == before[state]]
        if INSERT + before[NEXT[state]] == before[state]:
            choices.append(("I", None))
        letter, after = min(choices)
        letters += letter
        if after is not None:
            return letters, after
        state = NEXT[state]


remembered = lru_cache(maxsize=20_000)(unroll)


def cheapest(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and letters of the cheapest repair of runs of symbols."""
    left, behind = END, []
    for symbol, length in reversed(runs):
        for exponent in range(length.bit_length()):
            if length >> exponent & 1:
                behind.append((symbol, exponent, left))
                left = through(power(symbol, exponent), left)
    parts, state = [], START
    for symbol, exponent, after in reversed(behind):
        letters, state = unrolled(symbol, exponent, state, after)
        parts.append(letters)
    while END[state]:
        parts.append("I")
        state = NEXT[state]
    return left[START], "".join(parts)


def emitted(audit: str, initials: Iterator[str]) -> str:
    """For each letter the initial of the turn that comes out, or a dash."""
    state, found = START, []
    for letter in audit:
        initial = next(initials) if letter != "I" else ""
        if letter == "D":
            found.append("-")
            continue
        state = SYSTEM if letter == "K" and initial == "s" else NEXT[state]
        found.append("s" if state == SYSTEM else EMITTED[state])
    return "".join(found)


def numbered_turns(rows: DataFrame) -> DataFrame:
    """``tree, conv_id, turn, role, text, print, at, turns``: turns in order, numbered from 0."""
    told = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree"),
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    ).withColumn("print", F.md5(F.concat("role", F.lit("\n"), "text").cast("binary")))
    return stored(ranked(told, "tree", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "at", "turns"), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """``tree, at, turn, initial, fault, symbol`` of every turn; the first occurrence of a role and text is no duplicate."""
    light = turns.select(
        "tree",
        "at",
        "turn",
        "print",
        F.substring("role", 1, 1).alias("initial"),
        F.regexp_extract("text", rf"({WORD_CHARACTER})[\x20\x09-\x0D]*\z", 1).alias("last"),
    )
    first = light.groupBy("tree", "print").agg(F.min("at").alias("first"))
    fault = (
        F.when(F.col("last") == "", F.lit("blank"))
        .when(F.col("at") > F.col("first"), F.lit("duplicate"))
        .when(~F.col("last").isin(".", "!", "?"), F.lit("truncated"))
        .otherwise(F.lit(""))
    )
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x")).when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return light.join(first, ["tree", "print"]).withColumn("fault", fault).select("tree", "at", "turn", "initial", "fault", symbol.alias("symbol"))


def collapsed(marked: DataFrame) -> DataFrame:
    """One row for each conversation: its counts, and ``runs`` of equal symbols with the place where each begins."""
    before = marked.select(
        "tree", (F.col("at") + 1).alias("at"), F.col("turn").alias("turn_before"), F.col("initial").alias("initial_before"), F.col("symbol").alias("symbol_before")
    )
    pairs = marked.join(before, ["tree", "at"], "left")
    legal = F.concat("initial_before", "initial").isin("su", "ua", "au")
    begins = F.when(F.col("symbol_before").isNull() | (F.col("symbol") != F.col("symbol_before")), F.struct("at", "symbol"))
    other_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    return pairs.groupBy("tree").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if(other_turn), F.lit(0).cast("bigint")).alias("gaps"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
        F.count_if(~legal).alias("illegal"),
        F.count(F.lit(1)).alias("turns"),
        F.sort_array(F.collect_list(begins)).alias("runs"),
    )


def repairs_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The repair of each conversation, from its runs and its number of turns."""
    for all_runs, all_turns in batches:
        found = []
        for runs, turns in zip(all_runs, all_turns, strict=True):
            begins = [run["at"] for run in runs] + [turns]
            lengths = [(run["symbol"], int(end - begin)) for run, begin, end in zip(runs, begins, begins[1:], strict=False)]
            cost, audit = cheapest(lengths)
            initials = (symbol.lower() for symbol, length in lengths for _ in range(length))
            found.append((cost, audit, emitted(audit, initials)))
        yield pd.DataFrame(found, columns=["cost", "audit", "emitted"])


def edits_of(audits: DataFrame, letters: int = 200_000) -> DataFrame:
    """``tree, place, edit, came, at``: every edit, the turn that comes out, and the number of the turn edited."""
    columns = ("tree", "place", "edit", "came", "at")

    def table(parts: list[tuple]) -> pd.DataFrame:
        joined = [np.concatenate(column) for column in zip(*parts, strict=True)]
        rows = pd.DataFrame(dict(zip(columns, joined, strict=True)))
        return rows.assign(at=rows["at"].astype("Int64").where(rows["edit"] != "I"))

    def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for batch in batches:
            for tree, audit, came in batch.itertuples(index=False):
                edit, out = (np.frombuffer(text.encode("ascii"), "S1").astype("U1").astype(object) for text in (audit, came))
                at = np.cumsum(edit != "I") - 1
                for start in range(0, len(edit), letters):
                    piece = slice(start, start + letters)
                    size = len(edit[piece])
                    parts.append((np.full(size, tree, object), np.arange(start, start + size), edit[piece], out[piece], at[piece]))
                    held += size
                    if held >= letters:
                        yield table(parts)
                        parts, held = [], 0
        if parts:
            yield table(parts)

    return audits.select("tree", "audit", "emitted").mapInPandas(edits, "tree string, place bigint, edit string, came string, at bigint")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audit of every conversation, and its repaired turns.

    ``rows`` has ``conv_id, turn, role, text``; further columns are not used. The turns of a
    conversation stand by turn, nulls first, then by role and text. A null role or text is one
    space. A turn is blank without a character other than blanks, a duplicate if its role and text
    were seen before, truncated if its last such character is none of ``.!?``; the first of these
    counts. Blank turns and duplicates are deleted (2). Other turns are kept, given the role user
    or assistant (1) or deleted (2); a truncated one that stays costs 5. Turns without a text can
    be inserted (5). What comes out is nothing, or user and assistant in turn after a system turn
    or none. Of the cheapest repairs the one with the least letters is taken.

    The audit has ``tree, conv_id, gaps, blank, duplicate, truncated, illegal, turns, cost, audit,
    emitted``, with ``turn`` numbers missing in ``gaps``; the turns have ``tree, conv_id, place,
    edit, role, text``, ordered by ``place``. Repeated rows are duplicates. Turns of a null
    ``conv_id`` are one conversation. An empty table has none of either.
    """
    turns = numbered_turns(rows)
    marked = stored(faults(turns), "symbols")
    named = turns.where("at = 0").select("tree", "conv_id")
    repair = F.pandas_udf(repairs_of, "cost bigint, audit string, emitted string")
    found = collapsed(marked).withColumn("repair", repair("runs", "turns"))
    audits = stored(named.join(found, "tree").select(*named.columns, *found.drop("tree", "runs", "repair").columns, "repair.*"), "audits")
    edits = edits_of(audits).where("edit <> 'D'")
    joined = edits.join(turns.select("tree", "at", F.col("role").alias("own"), "text"), ["tree", "at"], "left")
    role = F.when(F.col("edit") == "K", F.col("own")).when(F.col("came") == "u", F.lit(ROLES["u"])).otherwise(F.lit(ROLES["a"]))
    out = joined.select("tree", "place", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return audits, out.join(audits.select("tree", "conv_id"), "tree").select("tree", "conv_id", "place", "edit", "role", "text")


def digests(lines: DataFrame) -> DataFrame:
    """``tree, sha256`` of the joined lines of ``tree, place, line``; a text is never held as a whole."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, running = None, None
        for batch in batches:
            ended = []
            for key, line in zip(batch["tree"], batch["line"], strict=True):
                if key == tree:
                    running.update(b"\n")
                else:
                    if running is not None:
                        ended.append((tree, running.hexdigest()))
                    tree, running = key, hashlib.sha256()
                running.update(line.encode("utf-8", "replace"))
            yield pd.DataFrame(ended, columns=["tree", "sha256"])
        if running is not None:
            yield pd.DataFrame([(tree, running.hexdigest())], columns=["tree", "sha256"])

    ordered = lines.select("tree", "place", "line").repartition("tree").sortWithinPartitions("tree", "place")
    return ordered.mapInPandas(digest, "tree string, sha256 string")
