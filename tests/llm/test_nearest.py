import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import nearest
from pagequarry.llm.oracles import ORACLES
from pagequarry.llm.queries import QUERIES


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def answers(frame):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("shard,leaf,block", [(8192, 128, 16 << 20), (64, 8, 3000)])
def test_against_brute_force(spark, monkeypatch, shard, leaf, block):
    for name, value in (("SHARD_ROWS", shard), ("LEAF_ROWS", leaf), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 6)).round(1)
    rows = [(n, [float(x) for x in base[rng.integers(40)]]) for n in range(600)]
    rows += [(650, None), (651, [1.0, None]), (700, [float("nan")] * 6), (701, [float("inf")] * 6), (None, [1.0] * 6), (750, [1.0, 2.0]), (751, [3.0, 4.0]), (800, []), (801, [])]
    rows += [rows[50], rows[3], rows[3], (900, [5.0] * 7)]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id bigint, embedding array<double>, rank int, score int").repartition(3)
    assert answers(nearest.top_k(frame, F.col("vec_id") % 50 == 0)) == brute(rows)
    assert nearest.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [3.0e6, -1.5]), (3, [-4.0e6, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert answers(nearest.top_k(frame, F.col("vec_id") % 50 == 0)) == brute(rows)


def test_components_beyond_doubles(spark):
    """Scaled components and scores have ends; sums whose terms cancel are exact before."""
    rows = [(0, [1e307, 1.0]), (1, [1e307, 0.0]), (2, [-1e307, 0.0]), (3, [0.0, 2.0]), (50, [1e9, -1e9]), (51, [1e9, 1e9]), (52, [-1e9, -1e9])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = answers(nearest.top_k(frame, F.col("vec_id") % 50 == 0))
    ends = lambda s: max(-(2**63), min(2**63 - 1, s))
    held = {i: [max(-int(nearest.LARGEST), min(int(nearest.LARGEST), math.floor(x) * 256)) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        scored = sorted((-ends(sum(a * b for a, b in zip(held[q], held[j]))), j) for j in held if j != q)
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])]
    assert got == sorted(want)


def test_pruning_skips_leaves(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(4000, 3)) * 256)
    tree, best = nearest.Tree(np.arange(4000), vectors), nearest.Best(10, 5)
    seen = []
    product = nearest._product
    monkeypatch.setattr(nearest, "_product", lambda a, b: seen.append(len(a) * len(b)) or product(a, b))
    nearest.search_shard(tree, np.arange(10), vectors[:10], best)
    assert sum(seen) < 10 * 4000 / 2


def test_whole_table(spark, folder):
    from compare import compare, sql_engine

    result = compare(spark, sql_engine(folder), "op6_topk", QUERIES["op6_topk"], ORACLES["op6_topk"], folder)
    assert result["ok"], result["why"]
