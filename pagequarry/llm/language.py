"""Language identification with bit-sliced Bloom filters of character trigrams.

Training counts trigrams per language over all labelled rows outside the held-out fold. Members of
a language are its most frequent trigrams: those that make up MIN_SHARE of it and more, and further
ones until the members hold HELD_SHARE of all its trigrams, as a script of many characters needs.
One lookup returns the bits of all languages that hold a trigram; a text's hits per language, less
those expected from false positives and as a part of what new text of that language would have,
decide.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.words import mixed, releasing
from pagequarry.session import materialise

# A share of a language's trigrams that always makes a trigram a member, the share that all members
# hold together, and how many members the model has room for, in each language.
MIN_SHARE = 2e-5
HELD_SHARE = 0.98
MOST_MEMBERS = 4_000_000
# A language is expected to know at least this share of new text in it.
LEAST_EXPECTED = 0.25
HASHES = 3
# Slots per member of the largest language.
SLOTS_PER_MEMBER = 16
UNKNOWN = "und"
FOLDS = 5
# Characters that are worked on at a time.
CHUNK = 1 << 20
# Distinct trigrams a task holds before it passes their counts on.
MOST_HELD = 1 << 21


@cache
def _letters() -> np.ndarray:
    """True for code points of a letter category."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One trigram for each letter, the letter in the middle, and where each text's begin.

    Letters are in lower case; what is not a letter counts as a gap.
    """
    lowered = [text.lower() for text in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    middle = np.flatnonzero(letter)
    kept = np.where(letter, points, 0).astype(np.int64)
    ids = (kept[middle - 1] << 42) | (kept[middle] << 21) | kept[middle + 1]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])]) + 1
    return ids, np.searchsorted(middle, bounds)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for n, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield first, n
            first, size = n, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


class _Counts:
    """Counts of one language; merged whenever the parts outgrow the merged ones."""

    def __init__(self) -> None:
        self.ids, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        found = np.unique(ids, return_counts=True)
        self.parts.append(found)
        self.waiting += len(found[0])
        if self.waiting > max(len(self.ids), 1 << 18):
            self.merge()

    def merge(self) -> None:
        ids = np.concatenate([self.ids, *(p[0] for p in self.parts)])
        counts = np.concatenate([self.counts, *(p[1] for p in self.parts)])
        self.ids, place = np.unique(ids, return_inverse=True)
        self.counts = np.bincount(place, counts, len(self.ids)).astype(np.int64)
        self.parts, self.waiting = [], 0


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """lang, gram and n: summed within each task before they are shuffled."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Counts] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.merge()
                for at in range(0, len(counts.ids), 100_000):
                    ids, n = counts.ids[at : at + 100_000], counts.counts[at : at + 100_000]
                    names = pa.array([lang] * len(ids), pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(ids), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                counts = held.setdefault(lang, _Counts())
                for first, last in _parts(own):
                    counts.add(trigrams(own[first:last])[0])
            if sum(len(c.ids) for c in held.values()) > MOST_HELD:
                yield from rows()
        yield from rows()

    counted = labelled.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """Slots of language bits, 64 languages to a plane.

    `expected` has the share of trigrams that a language's members hold in new text, 1 by default.
    """

    def __init__(self, members: dict[str, np.ndarray], expected: dict[str, float] | None = None) -> None:
        self.languages = sorted(members)
        most = max((len(ids) for ids in members.values()), default=0)
        self.size = 1 << max(10, (SLOTS_PER_MEMBER * most).bit_length())
        count = len(self.languages)
        self.kind = np.dtype(np.uint8 if count <= 8 else np.uint64)
        width = 8 * self.kind.itemsize
        self.planes = [np.zeros(self.size, self.kind) for _ in range(-(-count // width))]
        self.rates = np.zeros(count)
        self.expected = np.array([max(LEAST_EXPECTED, (expected or {}).get(lang, 1.0)) for lang in self.languages])
        for k, lang in enumerate(self.languages):
            plane, bit = self.planes[k // width], self.kind.type(1 << k % width)
            for slots in self._slots(members[lang]):
                plane[slots] |= bit
            self.rates[k] = np.count_nonzero(plane & bit) / self.size
        self.rates **= HASHES
        self.width = width

    def _slots(self, ids: np.ndarray) -> list[np.ndarray]:
        first = mixed(ids.view(np.uint64) if ids.dtype == np.int64 else ids)
        step = (first >> np.uint64(32)) | np.uint64(1)
        return [((first + np.uint64(k) * step) & np.uint64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and for each language the share of its trigrams that belong, as a
        part of the expected one."""
        ids, bounds = trigrams(texts)
        letters = np.diff(bounds)
        slots = self._slots(ids)
        out = np.zeros((len(texts), len(self.languages)))
        for p, plane in enumerate(self.planes):
            bits = plane[slots[0]]
            for more in slots[1:]:
                bits &= plane[more]
            for k in range(min(self.width, len(self.languages) - p * self.width)):
                hits = np.concatenate([[0], np.cumsum(bits >> self.kind.type(k) & self.kind.type(1), dtype=np.int64)])
                out[:, p * self.width + k] = hits[bounds[1:]] - hits[bounds[:-1]]
        out /= np.maximum(letters, 1)[:, None]
        return letters, np.clip((out - self.rates) / (1 - self.rates) / self.expected, 0, 1)

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        letters, shares = self.shares(texts)
        best = shares.argmax(axis=1)  # the first of equal ones: by name
        names = [self.languages[k] if n else UNKNOWN for k, n in zip(best, letters)]
        return names, np.where(letters > 0, shares.max(axis=1), 0.0)


def least_counts(counted: DataFrame, min_share: float, held_share: float, most: int) -> dict[str, tuple[int, int]]:
    """For each language how often its members occur at least, and how many trigrams it has in all.

    Counts are taken together by quarter powers of two: some 250 rows a language reach the driver.
    """
    size = F.floor(4 * F.log2("n")).alias("size")
    steps = counted.groupBy("lang", size).agg(
        F.min("n").alias("least"), F.sum("n").alias("n"), F.count("*").alias("grams")
    )
    of: dict[str, list] = {}
    for step in steps.collect():
        of.setdefault(step["lang"], []).append(step)
    found = {}
    for lang, own in of.items():
        own.sort(key=lambda step: -step["size"])
        total, held, grams, least = sum(step["n"] for step in own), 0, 0, own[0]["least"]
        for step in own:
            grams += step["grams"]
            if held >= held_share * total or grams > most:
                break
            held, least = held + step["n"], step["least"]
        always = max(1, math.ceil(min_share * total))  # 1 / min_share trigrams at most
        found[lang] = min(least, always), total
    return found


def fit(labelled: DataFrame, min_share: float = MIN_SHARE, held_share: float = HELD_SHARE, most: int = MOST_MEMBERS) -> LanguageFilter:
    """Train on every row with a text and a lang.

    The expected share of a language counts each occurrence of a trigram as if it were new text:
    known if the others alone make a member. A language of more than `most` members keeps the most
    frequent ones, and is expected to know less.
    """
    spark = labelled.sparkSession
    counted = materialise(count_trigrams(labelled.filter("text is not null and lang is not null")), "trigrams")
    least = least_counts(counted, min_share, held_share, most)
    if not least:
        return LanguageFilter({})
    limits = F.broadcast(spark.createDataFrame([(lang, cut) for lang, (cut, _) in least.items()], "lang string, cut bigint"))
    rows = counted.join(limits, "lang").filter("n >= cut").select("lang", "gram", "n").toArrow()
    names, grams, counts = (rows.column(c).combine_chunks() for c in ("lang", "gram", "n"))
    names = names.dictionary_encode()
    codes, grams, counts = names.indices.to_numpy(), grams.to_numpy(), counts.to_numpy()
    members, expected = {}, {}
    for code, lang in enumerate(names.dictionary.to_pylist()):
        cut, total = least[lang]
        own = codes == code
        members[lang] = np.sort(grams[own])
        expected[lang] = float(counts[own][counts[own] > cut].sum() / total)
    return LanguageFilter(members, expected)


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def predict(docs: DataFrame, model: LanguageFilter, *keep: str) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row of docs; reads the text only."""
    names = [f"_keep{n}" for n in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), F.coalesce("text", F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            found, scores = [], []
            for first, last in _parts(texts):
                part, sure = shared.value.decide(texts[first:last])
                found += part
                scores.append(sure)
            columns = [*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    found = rows.mapInArrow(run, f"{kept}{', ' if kept else ''}lang_pred string, score double")
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    `und` with score 0 where the text is null or has no letters, or nothing could be learned. A null
    doc_id is never learned from and not held out. Repeated rows are answered each time; no rows
    give no rows; other columns are not read.
    """
    found = predict(docs, fit(training_rows(docs)), "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, least: float) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language by at least `least`."""
    model = fit(training_rows(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(place).to_pylist()]
            good = []
            for first, last in _parts(texts):
                names, scores = shared.value.decide(texts[first:last])
                good += [name != UNKNOWN and score >= least for name, score in zip(names, scores)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
