"""Small awkward tables: nulls, empty, short and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

EDGE = [None, "", "  \n\t ", "a b", "A b", "a  b\t", "a b c", "é ü", "#$%&", "one two three four five", "x" * 3000, " ".join(["la"] * 4000)]


def documents(seed: int = 2) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): families of near copies, shared passages, the edge texts, repeated rows and null ids."""
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    texts: list[str | None] = []
    passages = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(3)]
    for _ in range(14):
        base = [draw.choice(words) for _ in range(draw.randint(3, 160))]
        for _ in range(draw.randint(1, 9)):
            text = list(base)
            for _ in range(draw.randint(0, 4)):
                at = draw.randrange(len(text))
                text[at : at + 1] = draw.choice([[], [draw.choice(words)], [text[at], draw.choice(words)]])
                text = text or ["w"]
            body = " ".join(text).replace("w1 ", "W1\n")
            texts.append(body + " " + draw.choice(passages) if draw.random() < 0.2 else body)
    texts += EDGE
    ids: list[int | None] = draw.sample(range(1000), len(texts) - 2)
    rows = list(zip([*ids, None, None], texts, strict=True))
    return rows + rows[:3] + [(rows[5][0], rows[6][1])]


def table(spark, rows):
    """The rows with further columns whose names operators use themselves."""
    wide = [(i, t, "en", "s", len(t or ""), 1, "k", 0.5, [1]) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, bucket int, _key string, score double, _words array<int>")


def empty(spark):
    return table(spark, [(1, "x")]).where("false")


def near(i: int | None) -> int:
    """A null id sorts last."""
    return (1 << 63) - 1 if i is None else i
