import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagequarry.llm import decontaminate
from pagequarry.llm.words import text_buffer


def terms(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def weights(items):
    """Normalised BM25 weights of every item, straight from the formula."""
    split = [terms(t) for t in items]
    mean = sum(map(len, split)) / len(split)
    out = []
    for own in split:
        w = {}
        for t in set(own):
            held = sum(t in s for s in split)
            n = own.count(t)
            w[t] = np.log(1 + (len(split) - held + 0.5) / (held + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean))
        total = sum(w.values())
        out.append({t: x / total for t, x in w.items()})
    return out


def runs(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(texts, items, stride, threshold=0.5):
    found, score_of = {}, weights(items)
    for d, text in enumerate(texts):
        words = terms(text)
        for j in range(max(1, -(-len(words) // stride) - 1)):
            own = words[j * stride : (j + 2) * stride]
            for i, w in enumerate(score_of):
                score = sum(x for t, x in w.items() if t in set(own))
                if score < threshold:
                    continue
                shares = []
                for part in decontaminate.question_and_answer(items[i]):
                    n = min(3, max(1, len(terms(part))))
                    grams = [tuple(terms(part)[k : k + n]) for k in range(len(terms(part)) - n + 1)]
                    shares.append(sum(g in runs(own, n) for g in grams) / len(grams) if grams else 0.0)
                if min(shares) >= 0.5:
                    found[d, i] = max(found.get((d, i), (0,)), (score, *shares))
    return found


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_index_against_formula(seed):
    rng = random.Random(seed)
    words = vocabulary(rng, 120)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [f"{prose(rng.randint(4, 40))}. {prose(rng.randint(3, 9))}." for _ in range(50)]
    texts = ["", prose(3), prose(900)]
    for k in range(60):
        item = items[rng.randrange(50)].split()
        part = item[rng.randint(0, 3) : len(item) - rng.randint(0, 3)]
        texts.append(" ".join([prose(rng.randint(0, 150)), *(rng.choice([w, w.upper(), w + "&&&"]) for w in part), prose(rng.randint(0, 80))]))
    built = decontaminate._words(items)
    names, place = np.unique(built.hashes, return_inverse=True)
    owner = np.repeat(np.arange(50), np.diff(built.firsts))
    held = np.bincount(np.unique(place * 50 + owner) // 50, minlength=len(names))
    index = decontaminate.Index(list(enumerate(items)), (names, held), 50, len(built.hashes) / 50)
    got = {(f.text, f.item): f[2:] for f in index.find(*text_buffer(pa.array(texts)))}
    want = brute(texts, items, index.stride)
    assert got.keys() == want.keys() and len(got) > 20
    for key, value in want.items():
        assert np.allclose(got[key], value)


def test_whole_table(spark, folder):
    from pagequarry.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id", "text").collect()
    stride = max(64, max(len(terms(i.text)) for i in items))
    want = brute([d.text for d in docs], [i.text for i in items], stride)
    rows = QUERIES["op1_decontaminate"](spark, folder).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted((docs[d].doc_id, items[i].item_id) for d, i in want)
    verbatim = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert verbatim and verbatim <= {(r.doc_id, r.item_id) for r in rows}
    kept = {r.doc_id for r in decontaminate.clean(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert kept == {d.doc_id for d in docs} - {r.doc_id for r in rows}


def test_tricky_and_empty(spark, tricky, nothing):
    item = max((r.text for r in tricky.collect() if r.text and 50 < len(r.text.split()) < 100), key=len)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a"), (1, item)], "item_id bigint, text string")
    rows = decontaminate.leaks(tricky, items).collect()
    assert {r.item_id for r in rows} == {1}
    assert {r.doc_id for r in rows} >= {r.doc_id for r in tricky.collect() if r.text == item}
    assert decontaminate.leaks(nothing, items).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(tricky, none).count() == 0
    assert decontaminate.clean(tricky, none).count() == tricky.count()
    assert decontaminate.clean(tricky, items).columns == tricky.columns


def test_rounds_agree(spark, tricky, monkeypatch):
    texts = [r.text for r in tricky.collect() if r.text and len(r.text.split()) > 8]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    order = lambda f: sorted((r.doc_id is None, r.doc_id or 0, r.item_id, round(r.score, 9)) for r in f.collect())
    whole = order(decontaminate.leaks(tricky, items.filter("length(text) < 700")))
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "LEAST_STRIDE", 200)
    parts = order(decontaminate.leaks(tricky, items.filter("length(text) < 700")))
    assert {p[:3] for p in parts} >= {w[:3] for w in whole if w[3] > 0.999}


def test_short_symbol_and_unspaced_items_are_found(spark):
    """Whole copies of items of few words, with a part of symbols, and of scripts without spaces."""
    chinese = "\u6c34\u5728\u591a\u5c11\u5ea6\u6cb8\u817e\uff1f\u4e00\u767e\u5ea6\u3002"
    thai = "\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e\u0e2d\u0e22\u0e39\u0e48\u0e17\u0e35\u0e48\u0e44\u0e2b\u0e19"
    items = ["Water boils hot", "Paris", "Which signs close the block. ) ; }", "a-b-c-d-e-f", chinese, "\u6771\u4eac", thai, "+ = +"]
    near = ["water boils very hot", "Parisian", "which signs close the block. ) }", "a b c d e", chinese[:3] + chinese[7:], "\u6771\u5357\u4eac", thai[:4], "+ +"]
    texts = [f"so it was said: {i.lower()}, once more" for i in items] + [f"so it was said: {n}, once more" for n in near]
    texts[4] = f"\u6211\u4eec\u95ee{chinese}\u7136\u540e"
    texts[5] = "\u6211\u5728\u6771\u4eac\u4f4f"
    frame = lambda rows, c: spark.createDataFrame(list(enumerate(rows)), f"{c} bigint, text string")
    rows = decontaminate.leaks(frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(n, n) for n in range(len(items))]
    kept = decontaminate.clean(frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(len(items), len(texts)))


def test_other_items_and_rounds_do_not_matter(spark, monkeypatch):
    rng = random.Random(4)
    words, other = vocabulary(rng, 400), [f"z{n}" for n in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    filler = lambda n: " ".join(rng.choice(other) for _ in range(n))
    short = [(n, f"{prose(12)}. {prose(6)}.") for n in range(6)]
    long = [(10, prose(200)), (11, prose(150)), (12, prose(700)), (13, prose(65))]
    texts = []
    for _, item in short + long:
        question, answer = decontaminate.question_and_answer(item)
        texts += [f"{filler(rng.randint(0, 300))} {question} {filler(gap)} {answer} {filler(rng.randint(0, 200))}" for gap in (0, 20, 60, 120, 300, 1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = lambda some: {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(some, "item_id bigint, text string")).collect()}
    alone, both = found(short), found(short + long)
    assert {f for f in both if f[1] < 10} == alone
    assert {f for f in both if f[1] >= 10} == found(long) >= {(6 * (6 + k), 10 + k) for k in range(4)}
    # The far copies of short items stay out, whatever the longest item.
    assert not {f for f in both if f[1] < 10 and f[0] % 6 > 3}
    monkeypatch.setattr(decontaminate, "ROUND_BYTES", 1500)
    assert found(short + long) == both


def test_short_items_and_the_words_that_remove(spark):
    frame = lambda rows, c: spark.createDataFrame(list(enumerate(rows)), f"{c} bigint, text string")
    texts = ["the cat sat", "of the cat, of the dog", "so the answer is four", "the answer is maybe four", None, "", "x " * 300 + "The Cat"]
    docs, items = frame(texts, "doc_id"), frame(["the", "the cat", "the answer is four", "+"], "item_id")
    rows = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (6, 0), (6, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items, least_words=2).collect()) == [3, 4, 5]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [4, 5]


def test_long_runs_over_passages(spark):
    """Items with a part of symbols, as long as several passages, in very long texts."""
    rng = random.Random(6)
    filler = " ".join(f"w{rng.randrange(900)}" for _ in range(300_000))
    item = " ".join(f"k{n}" for n in range(90)) + ". ) ; }"
    texts = [f"{filler} {item} {filler}", filler, item.replace("k44", "k45"), f"{' '.join(filler.split()[:70])} {item}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "a b"), (3, ") ; }")], "item_id bigint, text string")
    rows = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(0, 1), (0, 3), (2, 3), (3, 1), (3, 3)]
