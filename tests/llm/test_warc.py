import random

import pytest

from pagequarry.llm import warc
from pagequarry.llm.oracles import ORACLES
from pagequarry.llm.queries import QUERIES

MANIFEST = "file_id bigint, offset bigint, length bigint, digest string, record_id bigint, path string"


def manifest(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], MANIFEST)


def brute(one, two):
    held = [{}, {}]
    for side, rows in zip(held, (one, two)):
        for f, o, n, d, r in rows:
            if f is not None and o is not None:
                side.setdefault((f, o), []).append((n, d or "", r))
    out = []
    for key in held[0].keys() | held[1].keys():
        a, b = (sorted(h.get(key, []), key=str) for h in held)
        if a != b:
            out.append((*key, "missing" if not b else "extra" if not a else "changed"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_against_direct_comparison(spark, seed):
    rng = random.Random(seed)
    one = [(f, 1000 * k * (1 + f), 900, f"d{f}-{k}", k) for f in (0, 1, 2, 300, 70000, -4) for k in range(120)]
    two = [r if rng.random() > 0.02 else (*r[:3], "bad", r[4]) for r in one if rng.random() > 0.01]
    two += [(5, 10, 3, "new", 9), two[0], (None, 1, 1, "n", 1), (1, None, 1, "n", 1)]
    one += [one[7], one[7], (None, None, None, None, None)]
    got = warc.audit(manifest(spark, one), manifest(spark, two)).collect()
    assert sorted((r.file_id, r.offset, r.damage) for r in got) == brute(one, two)
    assert warc.audit(manifest(spark, one), manifest(spark, one)).count() == 0


def test_empty(spark):
    none, one = manifest(spark, []), manifest(spark, [(1, 0, 5, None, None)])
    assert warc.audit(none, none).count() == 0
    assert [r.damage for r in warc.audit(one, none).collect()] == ["missing"]
    assert [r.damage for r in warc.audit(none, one).collect()] == ["extra"]


def test_pages_with_nulls(spark):
    rows = [(None, "u", "h"), (1, None, None), (2, "", ""), (600, "http://a/", "<p>é</p>" * 9), (600, "http://a/", "<p>é</p>" * 9)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, offset int")
    original, copy = warc.replicas(pages)
    assert original.count() == 4
    assert warc.audit(original, original).count() == 0
    assert warc.audit(original, copy).count() <= 4


def test_unequal_branches_only(spark):
    """Below equal roots nothing differs."""
    rows = [(f, 70000 * k, 10, f"{f}{k}", k) for f in range(3) for k in range(5)]
    leaves = warc.leaves(manifest(spark, rows))
    levels = warc.levels_over(leaves)
    top = warc.tree(leaves, levels)[-1].collect()
    assert len(top) == 1 and levels == [False, True]


def test_whole_table(spark, folder):
    from compare import compare, sql_engine

    result = compare(spark, sql_engine(folder), "op5_fixity", QUERIES["op5_fixity"], ORACLES["op5_fixity"], folder)
    assert result["ok"], result["why"]
