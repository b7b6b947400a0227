"""Small corpora for the tests: awkward rows, and copies with known relations."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [
    (1, None, None, "a", 0),
    (2, "", "en", None, 0),
    (3, " \t\n\v\f\r ", "en", "a", None),
    (4, "one", "en", "a", 3),
    (5, "one", "en", "a", 3),
    (5, "one", "en", "a", 3),
    (None, "a text without a number", None, "a", 23),
    (6, "naïve café \U0001f600  x y ÉCOLE", "fr", "a", 30),
    (7, "1234 !!! ---", "de", "a", 12),
]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df, *names):
    """The rows with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("kept") for name in names})


def words(seed, count, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(count)]


def corpus(seed=1, size=60):
    """Texts with exact copies, near copies, a shared passage and a very long one."""
    draw = random.Random(seed)
    passage = words(99, 60, 5000)
    rows, texts = [], []
    for n in range(size):
        kind = draw.randrange(6)
        if kind == 0 and texts:
            own = list(draw.choice(texts))
        elif kind == 1 and texts:
            own = list(draw.choice(texts))
            for _ in range(draw.randrange(1, 6)):
                own[draw.randrange(len(own))] = f"new{draw.randrange(10**6)}"
        else:
            own = words(draw.random(), draw.randrange(1, 160), 3000)
        if kind == 2:
            at = draw.randrange(len(own) + 1)
            own[at:at] = passage
        texts.append(own)
        rows.append((n * 3, draw.choice([" ", "\n", "  "]).join(own), "en", "a", 0))
    rows.append((1000, " ".join(words(7, 30_000, 3000)), "en", "a", 0))
    rows.append((1001, " ".join(["again"] * 500), "en", "a", 0))
    return rows + AWKWARD[:6]
