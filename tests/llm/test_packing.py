import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagequarry.llm import packing


TOKENIZER = Tokenizer.from_file(packing.default_tokenizer())


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, docs, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids, at = whole(text), 0
        for r in sorted(pieces.pop(doc_id), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert not pieces
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
    return len(sequences)


@pytest.mark.parametrize("window", [16, 2048])
def test_round_trip(spark, tricky, window):
    docs = tricky.filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    made = check(packing.pack(docs, window).collect(), docs.select("doc_id", "text").collect(), window)
    tokens = sum(len(whole(t)) for _, t in docs.select("doc_id", "text").collect())
    assert made <= -(-tokens // window) + docs.rdd.getNumPartitions()


def test_repeated_and_null_rows(tricky, nothing):
    rows = packing.pack(tricky, 32).collect()
    total = sum(len(whole(r.text)) for r in tricky.select("text").collect())
    assert sum(r.length for r in rows) == total
    assert packing.pack(nothing).count() == 0


def test_whole_table(spark, folder):
    from pagequarry.llm.queries import QUERIES

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op2_pack"](spark, folder).collect(), docs, 2048)


def test_level_is_the_one_with_least_squares():
    rng = np.random.default_rng(3)
    levels = packing.LevelArray(24, 0)
    for size in rng.integers(1, 24, 300):
        best, want = None, 0
        for level in [0, *(h for h in levels.open if levels.open[h])]:
            if level + size > 24:
                continue
            after = {h: len(v) for h, v in levels.open.items()}
            if level:
                after[level] -= 1
            if level + size < 24:
                after[level + size] = after.get(level + size, 0) + 1
            cost = sum(n * n for n in after.values())
            if best is None or cost < best or (cost == best and level > want):
                best, want = cost, level
        assert levels.level_for(int(size)) == want
        levels.add(1, b"\0\0\0\0" * int(size))


def test_many_open_sequences_are_cut_again(monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 3)
    levels = packing.LevelArray(10, 0)
    for n in range(50):
        levels.add(n, b"\1\0\0\0" * (n % 9 + 1))
        assert levels.counts.sum() <= 4
    levels.close()
    assert sum(r[2] for r in levels.rows) == sum(n % 9 + 1 for n in range(50))


def test_encoder_forgets_and_agrees(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    encoder = packing.WordEncoder(packing.default_tokenizer())
    texts = ["it's a <|endoftext|> x<|startoftext|>y", "\u0301 e\u0301 \u00c9T\u00c9\u00a0\u2003b", "\x00 \x1c a", "", "don't 12 3.5 \u4e2d\u6587", "\u0130 \ufb01 \U0001f600!!"]
    for text in [*texts, *texts, *texts]:
        want = np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode([text.encode()]) == [want], text
