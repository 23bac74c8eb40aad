import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import language
from pagequarry.llm.queries import QUERIES


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def grams(text):
    low = f" {text.lower()} "
    is_letter = [unicodedata.category(c)[0] == "L" for c in low]
    kept = [c if k else "\0" for c, k in zip(low, is_letter)]
    return ["".join(kept[i - 1 : i + 2]) for i in range(1, len(low) - 1) if is_letter[i]]


def test_trigrams():
    rng = random.Random(2)
    texts = ["", "a", "É ß", "中文 a1b", "\U0001f600", "İi", *("".join(rng.choice("abÉ 1\n") for _ in range(30)) for _ in range(20))]
    ids, bounds = language.trigrams(texts)
    spell = lambda i: "".join(chr(i >> s & (1 << 21) - 1) for s in (42, 21, 0))
    assert [[spell(int(i)) for i in ids[a:b]] for a, b in zip(bounds, bounds[1:])] == [grams(t) for t in texts]


def test_filter_has_every_member_and_corrects_the_rest():
    rng = np.random.default_rng(4)
    members = {f"l{k:02}": rng.integers(0, 1 << 62, 500) for k in range(70)}
    model = language.LanguageFilter(members)
    assert (model.rates < 0.02).all()
    bits = [plane[slots] for plane in model.planes for slots in [model._slots(members["l69"])[0]]]
    assert len(bits) == 2
    for slots in model._slots(members["l69"]):
        assert (model.planes[1][slots] >> np.uint64(5) & np.uint64(1)).all()


def expected_shares(rows):
    """Memberships without a filter, from plain counts."""
    counts = {}
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and doc_id is not None and fold(doc_id):
            counts.setdefault(lang, Counter()).update(grams(text))
    return {lang: {g for g, n in c.items() if n >= language.MIN_SHARE * sum(c.values())} for lang, c in counts.items()}


def test_whole_table_against_plain_sets(spark, folder):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    members = expected_shares(rows)
    right = total = 0
    answers = {r.doc_id: r for r in QUERIES["op7_language"](spark, folder).collect()}
    assert len(answers) == len(rows)
    for doc_id, text, lang in rows:
        own, got = grams(text or ""), answers[doc_id]
        assert got.held_out == (fold(doc_id) == 0)
        if not own:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        shares = {name: sum(g in known for g in own) / len(own) for name, known in members.items()}
        assert abs(got.score - max(shares.values())) < 0.1
        assert shares[got.lang_pred] > max(shares.values()) - 0.1
        if got.held_out:
            total, right = total + 1, right + (got.lang_pred == lang)
    assert total > 20 and right >= 0.97 * total


def test_tricky_and_empty(spark, tricky, nothing):
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(tricky).collect()}
    assert (0, "und", 0.0) in rows and (2, "und", 0.0) in rows and any(r[0] is None for r in rows)
    assert language.identify(tricky).count() == tricky.count()
    assert language.identify(nothing).count() == 0
    assert {r.lang_pred for r in language.identify(tricky.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.known(tricky, 0.3)
    assert kept.columns == tricky.columns and kept.filter("text is null").count() == 0


@pytest.mark.parametrize("name", ["lang", "source"])
def test_labels_of_the_held_out_fold_do_not_matter(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    changed = docs.withColumn(name, F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col(name)))
    order = lambda f: sorted(map(tuple, f.collect()))
    assert order(language.identify(changed)) == order(language.identify(docs))


def many_characters(rng, length):
    """Text of 3,000 characters, common ones far more often."""
    points = 0x4E00 + np.minimum(rng.zipf(1.25, length) - 1, 2999)
    return "".join(map(chr, points))


def test_a_language_of_many_characters_is_known_to_the_same_degree(spark):
    rng = np.random.default_rng(5)
    words = ["there", "and", "then", "we", "go", "again", "some", "long", "path", "report", "of", "year", "others"]
    rows = [(n, many_characters(rng, 3000), "zh") for n in range(400)]
    rows += [(1000 + n, " ".join(rng.choice(words, 400)), "en") for n in range(100)]
    rows += [(2000, "", "zh"), (2001, None, "en"), (2002, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    training = language.training_rows(frame)
    counts = Counter(g for n, text, lang in rows if lang == "zh" and fold(n) for g in grams(text))
    total = sum(counts.values())
    cut, held = language.least_counts(language.count_trigrams(training.filter("text is not null and lang is not null")), language.MIN_SHARE, language.HELD_SHARE, language.MOST_MEMBERS)["zh"]
    assert held == total and sum(n for n in counts.values() if n >= cut) >= 0.9 * total
    assert sum(n for n in counts.values() if n >= language.MIN_SHARE * total) < 0.9 * total
    model = language.fit(training)
    expected = model.expected[model.languages.index("zh")]
    assert abs(expected - max(language.LEAST_EXPECTED, sum(n for n in counts.values() if n > cut) / total)) < 1e-9
    answers = [r for r in language.identify(frame).collect() if r.doc_id < 2000]
    assert all(r.lang_pred == ("zh" if r.doc_id < 1000 else "en") for r in answers)
    assert np.mean([r.score for r in answers if r.held_out and r.doc_id < 1000]) > 0.9
    assert language.known(frame, 0.3).filter("doc_id < 2000").count() == 500
    small = language.fit(training, most=50_000)
    assert len(small.planes[0]) < len(model.planes[0]) and small.expected.min() < expected
    assert {small.decide([text])[0][0] for n, text, lang in rows[:20]} == {"zh"}


def test_limits_of_few_counts(spark):
    frame = spark.createDataFrame([("a", 1, 7), ("a", 2, 1), ("b", 3, 1), ("c", 4, 1 << 40)], "lang string, gram bigint, n bigint")
    assert language.least_counts(frame, 2e-5, 0.98, 100) == {"a": (1, 8), "b": (1, 1), "c": (-(-(1 << 40) // 50_000), 1 << 40)}
    assert language.least_counts(frame.limit(0), 2e-5, 0.98, 100) == {}
