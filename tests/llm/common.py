"""Small tables with the cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

BASE = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder what all of this noise is about"


def edge_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and wordless texts, a very long text, ties, repeated rows, copies and near copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(40))
    rows: list[tuple] = [
        (0, None, "en", "a", None),
        (1, "", "en", None, 0),
        (2, " \t\n ", None, "a", 4),
        (3, "?!", "en", "b", 2),
        (4, "one", "en", "b", 3),
        (None, BASE, "en", "b", len(BASE)),
        (None, None, None, None, None),
        (6, BASE, "en", "b", len(BASE)),
        (7, BASE, None, "c", len(BASE)),
        (7, BASE, None, "c", len(BASE)),
        (8, BASE.upper(), "en", "c", len(BASE)),
        (9, passage + " x1 " + passage, "en", "a", 1),
        (10, "before it " + passage + " behind it", "en", "a", 1),
        (11, "é" * 150 + " ñandú 中文 😀 " + "é" * 150, "es", "é", 1),
        (12, " ".join(word() for _ in range(20_000)), "en", "a", 1),
        (13, "x" * 5000, "en", "a", 5000),
        (13, "another text of the same id", "en", "a", 27),
        (14, "▁ ▁▁a  b   c" + " " * 90 + "d", "en", "a", 1),
        (15, "it's we'll 'tis <|endoftext|> <s> \x00 \r\n", "en", "a", 1),
    ]
    words = [word() for _ in range(60)]
    for i in range(30):
        changed = list(words)
        for _ in range(i % 4):
            changed[rng.randrange(60)] = word()
        rows.append((100 + i, " ".join(changed), "en", "a", 1))
    return rows


def clashing(df):
    """The same rows with further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ("score", "set", "n", "doc", "tie", "copy", "block", "size", "taken", "print", "spans", "component_id", "kept", "lang_pred", "held_out")
    return df.withColumns({c: F.lit(7) for c in names})
