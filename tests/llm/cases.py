"""Rows that each operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

SYLLABLES = ["the", "on", "er", "ble", "ti", "sh", "nd", "ou", "re", "ing", "ña", "é"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    out = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", "a"), (4, None, "en", "a"), (5, "", "fr", "a"),
        (6, " \n\t ", "de", None), (7, prose(2, 30_000), "en", "a"), (8, "One two three four", None, "a"), (9, "ONE two\tthree four", "en", "a"),
        (10, "12 345 !!!", "en", "a"), (11, "a", "en", "a"), (None, prose(3, 50), "en", "a"), (1, base, "en", "a"), (12, base.upper(), "en", "a"),
        (13, prose(4, 9), "fr", "a"), (14, prose(4, 9) + " x", "fr", "a"), (15, "<|endoftext|> it's  we'll\r\n x’s ΑΣ 3½ <|startoftext|>", "fr", "a"),
    ]
    return out + [(100 + k, prose(50 + k, 40), ("en", "fr")[k % 2], "hot") for k in range(25)]


def documents(spark, data=None):
    """The columns of documents, and more whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows() if data is None else data, schema)
    return df.selectExpr("*", "7 as size", "'x' as shard", "1.5 as score", "'k' as key", "'c' as class", "array(1) as ids", "0 as n_words", "'h' as h", "false as learned")


def empty(spark):
    return documents(spark, []).limit(0)
