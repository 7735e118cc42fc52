"""A small table with every awkward row: nulls, empty and blank texts, a very long one, copies, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: Extra columns whose names operators use inside.
CLASHES = ("block", "doc", "id", "row", "words", "text_", "rest", "full", "n", "key", "k", "y", "t", "part", "sid")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(("the", "of", "and", "wharf", "cold", "river", "turn", "light", "stone", "paper", "glass", "wind")) + rng.choice(
        ("", "er", "ing", "s", "ed", "ly")) for _ in range(n)]
    return "\n".join(" ".join(words[i: i + 12]) + "." for i in range(0, n, 12))


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 300)) for _ in range(25)]
    passage = prose(rng, 90)
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    rows += [(100 + i, base[i]) for i in range(5)]                                   # exact copies under other ids
    for i in range(8):                                                               # near copies
        words = base[i].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40)) for i in range(4)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "a b c d"), (None, base[2]), (None, None),
             (1, base[1]), (1, base[1]), (7, "same id, other text " * 9), (500, prose(rng, 6000)), (501, "x" * 5000),
             (502, "ab " * 3000), (503, "Straße ÀÉ 東京 🙂 " * 40), (504, base[3] + "\r\n" + base[4])]
    return rows


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, ("en", "de", None)[n % 3], (f"src{n % 5}", None)[n % 11 == 0], len(t or ""), *["clash"] * len(CLASHES))
         for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
