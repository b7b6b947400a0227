"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Every measure is a column of the row's own text, so there is no shuffle. Arrays of a row
hold its words and three-word windows; memory follows the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.text import words_of

# Frequent words of four languages.
STOP_WORDS = tuple(
    """
    the of and to in a is that for it with as was on be by at from this an are or not have he you
    der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden an
    le la les de et des un une du en est que qui dans pour sur par au pas avec plus ne se ce il
    el los las y que del se por con no para su al lo como más o pero sus
    """.split()
)


@dataclass(frozen=True)
class Rule:
    """A text fails if the measure is below ``low`` or above ``high``; ``None`` leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


# Words and repeated words are the base rules, judged in whole numbers below.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", None, 0.2),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("shouting", "upper_word_ratio", None, 0.5),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("unfinished_lines", "ellipsis_line_ratio", None, 0.3),
    Rule("listed_lines", "bullet_line_ratio", None, 0.9),
)


def ratio(part: Column, whole: Column) -> Column:
    """A share; 0 of nothing."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def repeated_words(grams: Column) -> Column:
    """Words covered by a three-word window that occurs twice or more.

    ``grams`` holds a 64-bit hash of each window, in order. Only a text in which two are
    equal has them sorted; windows that occur once have no equal neighbour then.
    """
    in_order = F.sort_array(F.transform(grams, lambda gram, at: F.struct(gram.alias("gram"), at.alias("at"))))

    def covered(windows: Column) -> Column:
        def again(window: Column, at: Column) -> Column:
            before, after = F.get(windows, at - 1)["gram"], F.get(windows, at + 1)["gram"]
            return F.coalesce((window["gram"] == before) | (window["gram"] == after), window["gram"] == before, window["gram"] == after)

        starts = F.transform(F.filter(windows, again), lambda window: window["at"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda at: F.array(at, at + 1, at + 2)))))

    some = F.size(F.array_distinct(grams)) < F.size(grams)
    sizes = F.transform(F.when(some, F.array(in_order)).otherwise(F.array()), covered)
    return F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)).cast("bigint")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``quality``, a struct of counts and ratios of the text.

    A null text counts as empty; an empty text has all counts 0 and all ratios 0. Other
    columns stay as they are, whatever their names, but for one called ``quality``.
    """
    # Plain columns: Spark would copy the fields of a struct into each of their uses.
    taken = "_".join(docs.columns)
    w, n, g = f"words_{taken}", f"lines_{taken}", f"grams_{taken}"
    source, words, lines, grams = F.coalesce(F.col(text), F.lit("")), F.col(f"`{w}`"), F.col(f"`{n}`"), F.col(f"`{g}`")
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    prepared = docs.withColumns(
        {
            w: words_of(F.col(text)),
            n: F.filter(F.split(source, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))),
        }
    ).withColumn(g, F.transform(starts, lambda at: F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))))

    def of_words(test) -> Column:
        return F.size(F.filter(words, test)).cast("bigint")

    def of_lines(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda line: F.rlike(line, F.lit(pattern)))).cast("bigint")

    counts = [
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(source, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated_words(grams).alias("n_repeat_words"),
        of_words(lambda word: F.lower(word).isin(*STOP_WORDS)).alias("n_stop_words"),
        of_words(lambda word: (word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1)).alias("n_upper_words"),
        of_lines(r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("n_ellipsis_lines"),
        of_lines(r"^[\x20\x09-\x0D]*[-*•]").alias("n_bullet_lines"),
    ]
    names = {name: f"{name}_{taken}" for name in QUALITY_COUNTS}
    counted = prepared.withColumns(dict(zip(names.values(), counts, strict=True))).drop(w, n, g)
    count = {name: F.col(f"`{column}`") for name, column in names.items()}
    ratios = (
        ratio(count["word_chars"], count["n_words"]).alias("mean_word_chars"),
        ratio(count["n_symbols"], count["n_words"]).alias("symbol_ratio"),
        ratio(count["n_stop_words"], count["n_words"]).alias("stop_word_ratio"),
        ratio(count["n_upper_words"], count["n_words"]).alias("upper_word_ratio"),
        ratio(count["n_dup_lines"], count["n_lines"]).alias("dup_line_ratio"),
        ratio(count["n_ellipsis_lines"], count["n_lines"]).alias("ellipsis_line_ratio"),
        ratio(count["n_bullet_lines"], count["n_lines"]).alias("bullet_line_ratio"),
    )
    whole = F.struct(*[column.alias(name) for name, column in count.items()], *ratios)
    return counted.withColumn("quality", whole).drop(*names.values())


QUALITY_COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
    "n_upper_words",
    "n_ellipsis_lines",
    "n_bullet_lines",
)


def compiled(rules: tuple[Rule, ...], measures: str = "quality") -> Column:
    """The names of the rules that a row breaks, in the order of the table."""
    broken = []
    for rule in rules:
        value, fails = F.col(f"{measures}.{rule.measure}"), F.lit(False)
        if rule.low is not None:
            fails = fails | (value < F.lit(rule.low))
        if rule.high is not None:
            fails = fails | (value > F.lit(rule.high))
        broken.append(F.when(fails, F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judged(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Add ``quality`` (the measures), ``base_failed``, ``broken_rules`` and ``kept``.

    One row for each row, repeated ones included; an empty table stays empty. A null or
    empty text fails the base rules. Columns of these names are replaced.
    """
    words, repeats = F.col("quality.n_words"), F.col("quality.n_repeat_words")
    failed = (words < min_words) | (F.lit(100) * repeats > F.lit(max_repeat_percent) * words)
    return (
        measured(docs, text)
        .withColumns({"base_failed": failed, "broken_rules": compiled(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
    )
