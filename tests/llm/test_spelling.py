import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import compare, sql_engine

from pagequarry.llm import spelling
from pagequarry.llm.oracles import ORACLES
from pagequarry.llm.queries import QUERIES


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def vocabulary(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(counts):
    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = (form, n, len(others), form and counts[form])
    rows = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, n_near, form_n))
    return sorted(rows)


def answers(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in frame.collect())


def test_registered_query(spark, folder):
    got = compare(spark, sql_engine(folder), "op13", QUERIES["op13_spelling"], ORACLES["op13_spelling"], folder)
    assert got["ok"], got["why"]


@pytest.mark.parametrize("seed,letters,shortest", [(0, "abc", 4), (1, "ab", 6), (2, "aàéz\U0001f600中", 4)])
def test_all_pairs(spark, seed, letters, shortest):
    """Few letters give many equal bigrams, ties and prefixes that end at one weight."""
    rng = random.Random(seed)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, 9))): rng.choice([5, 6, 30, 200, 200, 2000]) for _ in range(500)}
    got = answers(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(5)))
    assert got == brute(counts)


def test_chains_of_forms(spark):
    words = ["aaaaaaaa"[: k] + "bbbbbbbb"[k:] for k in range(9)]
    counts = {w: 5**k for k, w in enumerate(words)}
    got = answers(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert got == brute(counts) and {r[2] for r in got} == {words[-1]}


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(1)
    for _ in range(500):
        weights = rng.integers(0, rng.integers(1, 20) + 1, rng.integers(3, 15))
        places, pivots = spelling.prefix_and_pivots(weights)
        assert set(places) == {k for k, w in enumerate(weights) if w <= np.sort(weights)[2]}
        costs = [weights[a] + weights[b] for a in places for b in places if a + 2 <= b]
        assert len(pivots) == 2 and pivots[1] - pivots[0] >= 2 and weights[pivots].sum() == min(costs)


def test_texts_with_every_oddity(spark):
    rng = random.Random(7)
    words = [f"{'straße naïveté Übermut window winter winder ordinary ORDINARY'.split()[k % 8]}" for k in range(40)]
    rows = [(n, " ".join(rng.choice(words) for _ in range(300))) for n in range(40)] + [(None, "ordinary " * 5), (None, None), (3, None), (4, ""), (5, "×÷ÀÿÀÿ Àÿ×÷Àÿ " * 6), (6, "word " * 300_000 + "straße" * 10), (7, "a" * 500_000)]
    rows += [rows[0]] * 3
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, word string, n int").repartition(4)
    assert answers(spelling.document_variants(frame)) == brute(vocabulary(rows))
    assert answers(spelling.document_variants(frame.limit(0))) == []
    assert answers(spelling.document_variants(frame.filter("text is null"))) == []
