from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, start string, group_hash int, pii int"


def tricky_rows() -> list[tuple]:
    """Nulls, empty and long texts, repeated rows, ties, and white space of every kind."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [None, "", " ", "\n\t\x0b\x0c\r", "a", "é ß 中文 \U0001f600 x", "one two three four", "one two three four five", prose(5000)]
    texts += [prose(rng.randint(1, 120)) for _ in range(30)]
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(6)]
    near = prose(200).split()
    for k in range(8):
        copy = list(near)
        copy[(17 * k) % 200] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [texts[10]] * 4 + ["same same same " * 30] * 2
    rows = [(n, t, ["en", "fr", None][n % 3], f"s{n % 2}", len(t or "")) for n, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, prose(50), "en", None, None), (None, None, None, None, None)]
    return [r + ("w", None, 1, None) for r in rows]


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(tricky_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
