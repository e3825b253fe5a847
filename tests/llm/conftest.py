"""Awkward rows that every operator has to take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, n int, key string, pos int, component string, id string, words string"
_rng = random.Random(4)
WORDS = ["".join(_rng.choice("abcdefghijklmnoprstuvw") for _ in range(_rng.randint(2, 9))) for _ in range(400)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows() -> list[tuple]:
    """Null and empty texts, null columns, ties, copies, one long text, repeated rows."""
    long = prose(30_000, 1)
    line = "This very line is found in many documents of the table."
    base = prose(80, 2)
    near = base.split()
    near[40] = "changed"
    texts = [
        (0, None), (1, ""), (2, " \t\n \x0b"), (3, "one"), (4, "two words"), (5, base), (6, base.upper()), (7, " ".join(near)), (8, f"{line}\n{prose(60, 3)}"), (9, f"{prose(60, 4)}\n  {line.upper()}  \n{line}"),
        (10, line), (11, long), (12, long + " tail"), (13, prose(60, 5) + "\n" + prose(3, 6)), (14, "ünï ÄÖ ß — «x» 你好 мир"), (15, "\n\n\n"), (16, "a\r\nb\r\nc"), (17, "#" * 60), (18, "<|endoftext|> is text, is it? yes."), (20, base), (20, base),
    ]
    return [(i, t, None if i % 5 == 2 else "en", None if i % 4 == 0 else f"src{i % 3}", None if t is None else len(t), "x", 7, None, 3, "c", "i", "w") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
