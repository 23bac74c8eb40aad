import random
import re

import numpy as np
import pytest

from pagequarry.llm import components, jaccard


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for n, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(n)
    pairs = {(a, b) for h in holders.values() for a in h[:400] for b in h[:400] if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(n)] = min(doc_id, least.get(find(n), doc_id))
    return sorted(((d, len(sets[n]), least.get(find(n)) if sets[n] else d) for n, (d, _) in enumerate(rows)), key=str)


def answers(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


def family(rng, size, words, edits):
    base = [f"f{rng.random():.6f}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.random():.6f}"
        out.append(" ".join(copy))
    return out


def families(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{n}" for n in range(60))
    texts = [t for _ in range(6) for t in family(rng, rng.randint(2, 5), rng.randint(5, 120), 4)]
    texts += family(rng, 50, 160, 5)
    texts += [f"{' '.join(family(rng, 1, rng.randint(10, 60), 0))} {passage}" for _ in range(40)]
    texts += [texts[0].upper()] * 3
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_tricky_and_empty(tricky, nothing):
    rows = [(r.doc_id, r.text) for r in tricky.select("doc_id", "text").collect()]
    assert answers(jaccard.classes(tricky)) == brute(rows)
    assert jaccard.classes(nothing).count() == 0
    kept = jaccard.keep_one(tricky)
    want = {c for d, n, c in brute(rows)}
    assert kept.columns == tricky.columns and {r.doc_id for r in kept.collect()} == want | {None}


def test_keep_one_with_any_column_names(spark):
    rows = [(n, "one two three four five six", 1, 2) for n in range(3)] + [(None, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int, gone_______ int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["0", "None"]


@pytest.mark.parametrize("seed,block,common", [(0, 4096, 1e-3), (1, 16, 1.0), (2, 7, 0.2)])
def test_families(spark, monkeypatch, seed, block, common):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COMMON_SHARE", common)
    rows = families(seed)
    got = answers(jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)))
    assert got == brute(rows)


def test_whole_table(spark, folder):
    from pagequarry.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert answers(QUERIES["op9_jaccard"](spark, folder)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_tree_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = []
    for _ in range(300):
        at, n = rng.integers(0, 8) * 400, rng.integers(5, 300)
        sets.append(np.unique(np.concatenate([base[at : at + n], rng.integers(0, 2**63, rng.integers(0, 40)).astype(np.uint64)])))
    points = np.array([jaccard.folded(jaccard.unpacked(jaccard.packed(jaccard.count_vector(s))), jaccard.DIMENSIONS) for s in sets])
    sizes = np.array([len(s) for s in sets])
    found = set(zip(*(x.tolist() for x in jaccard.CountTree(points, sizes).search(points, sizes))))
    assert len(found) < 300 * 300 / 3
    for a in range(300):
        for b in range(300):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found
                vectors = [jaccard.unpacked(jaccard.packed(jaccard.count_vector(sets[k]))) for k in (a, b)]
                assert jaccard.may_link(len(sets[a]), vectors[0], len(sets[b]), vectors[1])


def test_components(spark):
    rng = random.Random(3)
    links = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1100)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert got == {x: find(x) for pair in links for x in pair if find(x) != x}


def test_passages_of_a_few_documents_come_late(spark):
    """Whatever the number of documents: under a shingle that is not common all that have it are compared."""
    passage = " ".join(f"p{n}" for n in range(30))
    rows = [(n, f"a{n} b{n} c{n} d{n} e{n} f{n}") for n in range(18_000)]
    rows += [(20_000 + n, " ".join(f"u{n}x{k}" for k in range(20)) + " " + passage) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    found = jaccard._features(docs)
    counted = found.filter("shingle is not null").select("shingle", "n")
    assert found.filter("shingle is null").count() == len(rows)
    common = jaccard._common(counted, len(rows))
    data, offsets = jaccard.text_buffer(jaccard.pa.array([passage]))
    assert common[0].tolist() == jaccard.shingle_sets(data, offsets).values.tolist()
    shared = spark.sparkContext.broadcast(common)
    keys = jaccard._shared_keys(jaccard._prefix_keys(docs, shared, 3), 3)
    assert keys.count() == 0


def test_most_common_shingles_are_bounded(spark, monkeypatch):
    counted = spark.createDataFrame([(n, 16 + n // 10) for n in range(100)], "shingle bigint, n bigint")
    monkeypatch.setattr(jaccard, "MOST_COMMON", 35)
    assert sorted(jaccard._common(counted, 100)[0].tolist()) == list(range(70, 100))


@pytest.mark.parametrize("seed", range(3))
def test_prefixes(seed):
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**64, 900, dtype=np.uint64))
    common = base[rng.random(len(base)) < 0.6]
    places = rng.integers(4, 8, len(common))
    late = dict(zip(common.tolist(), places.tolist()))
    known = np.zeros(1 << jaccard.KNOWN_BITS, bool)
    known[common >> np.uint64(64 - jaccard.KNOWN_BITS)] = True
    parts = [np.sort(rng.choice(base, n, replace=False)) for n in (0, 1, 2, 3, 4, 5, 0, 17, 400, 800)]
    sets = jaccard.Sets(np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])))
    owner, keys = jaccard.prefixes(sets, jaccard.late_places(sets.values, common, places, known))
    for n, own in enumerate(parts):
        want = sorted(own.tolist(), key=lambda x: (late.get(x, 0), x))[: len(own) // 4 + 1]
        assert sorted(keys[owner == n].tolist()) == sorted(want)


def test_vectors_of_a_column():
    rng = np.random.default_rng(4)
    parts = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 900, 1100, 9000, 40)]
    parts += [np.unique(np.arange(40, dtype=np.uint64) * np.uint64(4096)), np.sort(np.append(parts[1][9:], parts[0]))]
    sets = jaccard.Sets(np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts])))
    packed = jaccard.packed_sets(sets)
    assert packed == [jaccard.packed(jaccard.count_vector(p)) for p in parts]
    column = jaccard.Vectors(jaccard.pa.array([b"", *packed], jaccard.pa.binary()).slice(1))
    single = [jaccard.unpacked(p) for p in packed]
    assert column.points(32).tolist() == [jaccard.folded(v, 32).tolist() for v in single]
    a, b = (x.ravel() for x in np.indices((len(parts), len(parts))))
    want = [bool(jaccard.may_link(len(parts[x]), single[x], len(parts[y]), single[y])) for x, y in zip(a, b)]
    assert jaccard.may_links(sets.sizes, column, sets.sizes, column, a, b).tolist() == want
    assert len(jaccard.may_links(sets.sizes, column, sets.sizes, column, a[:0], b[:0])) == 0


def test_cells_of_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "KEYS", 50)
    rows = families(7)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert answers(jaccard.classes(frame)) == brute(rows)
