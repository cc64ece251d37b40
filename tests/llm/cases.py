"""A small corpus with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, t string, h long, n long, c string, word string, kept boolean, snap boolean"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    passage = words(rng, 70)
    base = words(rng, 120)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A b c a b c d")]
    for i in range(10, 22):
        rows.append((i, " ".join(words(rng, 60))))
    for i in range(22, 30):  # a shared passage at different places
        rows.append((i, " ".join(words(rng, rng.randrange(30)) + passage[rng.randrange(8) :] + words(rng, rng.randrange(30)))))
    for i in range(30, 40):  # near copies
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    for i in range(40, 46):  # small sets that differ by one word at an end
        rows.append((i, " ".join(["p", "q", "r", "s", "u", "v", "w", "y", "z", "k", "l", "m"][: 12 - i % 3])))
    rows += [(46, rows[10][1]), (47, rows[10][1].upper()), (48, (rows[10][1] or "").replace(" ", "\n ")), (49, " ".join(words(rng, 3000)))]
    rows += [(50, "loop " * 300), (51, "loop " * 200), (None, rows[12][1]), (None, None), (52, "l1 x y z w v u\nl2 x y z w v u\nl3 tail"), (53, "own\nl1 x y z w v u\nl2 x y z w v u\nrest")]
    return rows + [rows[11], rows[30]]  # repeated rows


def frame(spark, rows=None):
    made = [(i, x, "en", "s", 0, 1, "t", 2, 3, "c", "w", True, False) for i, x in (texts() if rows is None else rows)]
    return spark.createDataFrame(made, SCHEMA)
