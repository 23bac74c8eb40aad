import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagequarry.llm import substrings
from pagequarry.llm.words import find_words, text_buffer
import pyarrow as pa


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def answers(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()), key=str)


def test_tricky_and_empty(tricky, nothing):
    rows = [(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
    got = answers(substrings.remove_repeats(tricky))
    assert got == brute(rows, 35) and sum(g[2] for g in got) > 0
    assert substrings.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("seed,window", [(0, 35), (1, 8), (2, 1)])
def test_random_repeats(spark, seed, window):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(4 if seed else 3)]
    pool = [[rng.choice(words) for _ in range(rng.randint(1, 3 * window))] for _ in range(4)]
    rows = []
    for n in range(40):
        parts = [rng.choice([*pool, [f"u{rng.random()}"] * 2, [rng.choice(words)] * rng.randint(1, 2 * window)]) for _ in range(rng.randint(0, 4))]
        rows.append((n, rng.choice([" ", "\n", "  \t"]).join(w for p in parts for w in p)))
    got = answers(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), window))
    assert got == brute(rows, window)


def test_whole_table(spark, folder):
    from pagequarry.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert answers(QUERIES["op4_substrings"](spark, folder)) == brute(rows, 35)


def test_levels_double():
    assert substrings.levels(35) == [9, 18, 35] and substrings.levels(32) == [8, 16, 32] and substrings.levels(1) == [1]


def test_leftmost_least():
    rng = np.random.default_rng(1)
    for width in (1, 2, 7, 27):
        x = rng.integers(0, 5, 100).astype(np.uint64)
        want = [i + int(np.argmin(x[i : i + width])) for i in range(101 - width)]
        assert substrings.leftmost_least(x, width).tolist() == want


def test_words_and_hashes(monkeypatch):
    from pagequarry.llm import words as w

    monkeypatch.setattr(w, "PIECE", 8)
    w._tables.cache_clear()
    texts = ["a bb\tccc", "", "  x ", "longer-than-a-piece-of-eight bb", "bb\n", "é é"]
    data, offsets = text_buffer(pa.array([None, *texts]))
    got = find_words(data, offsets)
    spelled = [data[offsets[0] :][a:b].tobytes().decode() for a, b in zip(got.starts, got.ends)]
    assert spelled == [x for t in texts for x in t.split()]
    assert got.firsts.tolist() == [0, *np.cumsum([0, *(len(t.split()) for t in texts)]).tolist()]
    by_word = {}
    for word, h in zip(spelled, got.hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    w._tables.cache_clear()


def test_heavy_runs_agree(spark, tricky, monkeypatch):
    """Runs of two rows and more answered by their list, and stretches joined by a salt or by key."""
    from pagequarry.operators import joins

    rows = [(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
    monkeypatch.setattr(substrings, "LEAST_HEAVY", 2)
    monkeypatch.setattr(substrings, "MOST_HEAVY", 5)
    monkeypatch.setattr(substrings, "join_unique", lambda a, b, on: joins.join_unique(a, b, on, least_heavy=2, most_bytes=0))
    assert answers(substrings.remove_repeats(tricky)) == brute(rows, 35)


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    """A default batch of long texts, in every worker, passed the memory of an executor."""
    from pagequarry.llm import queries

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        text = " ".join(f"w{n}" for n in range(40))
        spark.createDataFrame([(1, text), (2, text + " x"), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
        got = {r["doc_id"]: r["n_removed"] for r in queries.op4_substrings(spark, str(tmp_path)).collect()}
        assert got == {1: 40, 2: 40, 3: 0}
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
