"""A table of awkward documents: nulls, empty and very long texts, repeated rows and ids, columns with clashing names."""

import random

CLASHES = ("length", "n", "row", "h", "part", "shard", "size", "kept", "score", "label", "places", "lane", "_nth", "_found", "_row", "block", "tasks")
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(words: int, seed: int = 0) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeghiklmnoprstuvz") for _ in range(rng.randint(2, 9))) for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    long = prose(40_000, 1)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, prose(60, 2)), (7, prose(60, 2)), (7, prose(60, 2)), (8, long), (9, long + " end"),
        (None, prose(50, 3)), (None, prose(50, 3)), (None, None), (10, "é" * 300 + " ß"), (11, "x" * 5000), (12, "日本 語 " * 40), (13, prose(60, 2) + " more"),
    ]


def docs(spark):
    return spark.createDataFrame([(i, t, *("c" for _ in CLASHES)) for i, t in texts()], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
