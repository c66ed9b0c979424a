"""Small messy inputs shared by the tests."""

from __future__ import annotations

import random
import re

CLASH = ["n", "node", "score", "keep_id", "group_size", "kept", "text_sha256", "copies", "size", "_w", "_id", "spans"]
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def sentence(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed: int = 5) -> list[tuple[int, str | None]]:
    """Random texts, near copies of several strengths, exact copies, texts with
    a common passage, short, empty, null and very long texts."""
    rng = random.Random(seed)
    rows: list[str | None] = [None, "", "   ", "one", "One two", "a b c", "A b\tC", "a b c d", "a b c d e", "Été É été", "x" * 5000]
    passage = sentence(rng, 40)
    for _ in range(40):
        body = sentence(rng, rng.randrange(20, 120))
        cut = rng.randrange(len(body))
        rows.append(" ".join(body[:cut] + passage + body[cut:]))
    base = sentence(rng, 150)
    for k in range(40):
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    for n in (6, 7, 9, 30, 400):
        body = sentence(rng, n + 3)
        rows += [" ".join(body), " ".join(body), " ".join(body + ["tail"]), " ".join(body[1:]).upper()]
    rows.append(" ".join(sentence(rng, 20000)))
    rows += [rows[-1], (rows[-1] or "") + " end"]
    rng.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


def frame(spark, rows, **extra):
    """``documents`` rows with source and clashing further columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, None if k % 7 == 0 else f"s{k % 5}") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df.repartition(3)
