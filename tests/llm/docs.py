"""Small tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred int, id string, n double, key string, hits string, root string"


def table(spark, rows):
    """(doc_id, text[, lang]) rows with further columns whose names clash with inner ones."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), "x", 1, "y", 0.5, None, "z", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(1, 9))) for _ in range(vocabulary)]
    return [r.choice(words) for _ in range(n)]


def odd_rows():
    """Nulls, empty and white texts, repeated rows, a very long text, other scripts."""
    long = " ".join(prose(1, 30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (5, "one two"), (6, long), (7, long), (8, "日本語 の テキスト <|endoftext|> it's we'll"),
        (None, "no id here"), (None, None), (9, "x " * 50), (10, "x " * 50), (11, "a\x1cb\x85c d e"),
    ]
