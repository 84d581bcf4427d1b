"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

TEXT = "the quick brown fox jumps over the lazy dog and then some other words follow it until the line is long enough"

ODD = [
    (1, TEXT),
    (1, TEXT),
    (2, TEXT),
    (None, TEXT),
    (None, None),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "é ü 你好 " * 40),
    (7, "a " * 30_000),
    (8, "x" * 50_000),
    (9, TEXT.upper()),
    (9, "another text of the same id"),
    (10, "\n".join([TEXT, "second line", "third line", TEXT])),
    (11, "\n".join(["first", TEXT, "second line", "third line", TEXT])),
]


def odd_docs(spark, rows=ODD):
    """doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves."""
    full = [(d, t, ("en", "de", None)[i % 3], ("s", None)[i % 2], len(t or ""), -i, f"x{i}", 0.5, i) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp long, kept string, score double, n_words int")


def texts(seed, n, words=12, most=120):
    """Small vocabularies: much repeats."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    whole = [" ".join(rng.choices(vocabulary, k=rng.randrange(most))) for _ in range(n)]
    for _ in range(n // 3):
        a, b = rng.randrange(n), rng.randrange(n)
        cut = rng.randrange(len(whole[a]) + 1)
        whole[b] = whole[b][: rng.randrange(len(whole[b]) + 1)] + " " + whole[a][cut:]
    return whole
