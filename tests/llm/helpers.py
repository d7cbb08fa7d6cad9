"""Fixtures for the operator tests: messy documents and a random corpus with copies."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, size string, key int, score double, kept string"


def documents(spark, rows):
    """``rows`` of (doc_id, text, source) with extra columns whose names clash."""
    data = [(i, t, None, s, None if t is None else len(t), "other", "x", 7, None, "no") for i, t, s in rows]
    return spark.createDataFrame(data, DOCS)


def messy(spark):
    """Nulls, empty texts, ties, repeated rows, one very long text."""
    long_text = " ".join(f"w{i % 997}" for i in range(30_000)) + "\n" + "x" * 50_000
    rows = [
        (1, "alpha beta gamma delta", "s1"),
        (1, "alpha beta gamma delta", "s1"),
        (1, "another text of the same id", "s2"),
        (2, None, "s1"),
        (3, "", None),
        (None, "alpha beta gamma delta", None),
        (None, None, None),
        (4, " \t\n\r ", "s2"),
        (5, long_text, "s1"),
        (6, long_text, "s2"),
        (7, "éè ñ 漢字 😀   x", "é"),
    ]
    return documents(spark, rows)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def corpus(seed, n=120, vocabulary=400, copies=0.4):
    """Texts of which many are copies of earlier ones, whole or with a few edits."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < copies:
            words = rng.choice(out).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(vocabulary)}"
            if rng.random() < 0.2:
                words = words[: len(words) // 2] + [f"v{rng.randrange(vocabulary)}" for _ in range(10)]
        else:
            words = [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 90))]
        out.append(" ".join(words))
    return out
