"""Exact removal of repeated word windows by level-wise doubling.

A window of `window` words can occur twice only if every shorter run inside it does. At each level
every window that is still a candidate names one run of the level's length, the one of least hash
inside it; equal windows name equal runs at equal places. Windows whose run occurs once are out.
The survivors go on to runs of twice the length, until the runs are the windows themselves or no
candidate is left. The first level needs one run in about fourteen words; later levels see the
surviving stretches only, and stretches of equal content once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.filters import known_to
from pagequarry.llm.words import chunks, expand, find_words, mixed, releasing, shingles, text_buffer
from pagequarry.operators.joins import LEAST_HEAVY, MOST_HEAVY, join_unique
from pagequarry.session import materialise

WINDOW = 35
KEY = ["_a", "_b"]
STRETCH = pa.struct([("start", pa.int32()), ("content", pa.int64()), ("words", pa.binary())])


def levels(window: int) -> list[int]:
    """Run lengths: a quarter of the window, doubled up to the window."""
    found = [-(-window // 4)]
    while found[-1] < window:
        found.append(min(window, 2 * found[-1]))
    return found


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For every `width` neighbours, the place of the least value, the first of equal ones."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        count = max(0, len(at) - step)
        one, two = at[:count], at[step : step + count]
        at = np.where(values[two] < values[one], two, one)
        span += step
    return at


def named_runs(hashes: np.ndarray, firsts: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts whose words begin at `firsts`: the text, the first word, and the
    place of the run that each window names. Places count from the start of `hashes`."""
    counts = np.maximum(0, np.diff(firsts) - window + 1)
    text, start = expand(firsts[:-1], counts)
    least = leftmost_least(shingles(hashes, length), window - length + 1)
    return text, start, least[start]


def _with_key(docs: DataFrame) -> DataFrame:
    """Equal rows have equal keys."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_a"), F.hash("doc_id", "text").alias("_b"))


def _lists(owner: np.ndarray, values: np.ndarray, count: int, kind: pa.DataType) -> pa.Array:
    """Lists of values by owner; owners are in order."""
    offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _described(docs: DataFrame, window: int) -> DataFrame:
    """Number of words and hash of every text, and the runs its windows name at the first level."""
    length = levels(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for first, last in chunks(offsets):
                words = find_words(data, offsets[first : last + 1])
                whole = [hashlib.sha256(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())).hexdigest() for i in range(first, last)]
                text, _, place = named_runs(words.hashes, words.firsts, length, window)
                fresh = np.ones(len(place), bool)
                fresh[1:] = place[1:] != place[:-1]
                text, place = text[fresh], place[fresh]
                runs = shingles(words.hashes, length)[place].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(first, last - first) for c in ("doc_id", *KEY)),
                        pa.array(np.diff(words.firsts), pa.int64()),
                        pa.array(whole),
                        _lists(text, runs, last - first, pa.int64()),
                        _lists(text, place - words.firsts[text], last - first, pa.int32()),
                    ],
                    ["doc_id", *KEY, "n_words", "whole", "runs", "places"],
                )

    return docs.mapInArrow(releasing(run), "doc_id bigint, _a bigint, _b int, n_words bigint, whole string, runs array<bigint>, places array<int>")


def _repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """From (run, weight, place, *by): the places, by key, whose run has a weight of two or more.
    Rows that weigh more than one are counted, and need no answer.

    Runs are counted within each task before they are shuffled, so one that is everywhere is cheap.
    Rows of the heaviest repeated runs are known by a list of these; of the others only those go to
    the join that a filter lets through.
    """
    counted = rows.groupBy("run").agg(F.sum("weight").alias("_weight"), F.count("*").alias("_rows")).filter("_weight > 1")
    counted = materialise(counted.select("run", "_rows"), "substring-repeated")
    found = counted.filter(F.col("_rows") >= LEAST_HEAVY).orderBy(F.desc("_rows"), "run").limit(MOST_HEAVY)
    heavy = F.col("run").isin([r.run for r in found.collect()])
    light = rows.filter("weight = 1").filter(~heavy).filter(known_to(counted, "run", "run"))
    alive = light.join(counted.filter(~heavy).select("run"), "run", "left_semi").unionByName(rows.filter("weight = 1").filter(heavy))
    return alive.groupBy(*by).agg(F.collect_set("place").alias("alive"))


def _stretches(alive: np.ndarray, start: np.ndarray, text: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """Text, first and last word of what the surviving windows cover together."""
    start, text = start[alive], text[alive]
    if not len(start):
        return
    cut = np.flatnonzero((start[1:] > start[:-1] + window) | (text[1:] != text[:-1])) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]])):
        yield int(text[a]), int(start[a]), int(start[b - 1]) + window


def _alive(text: np.ndarray, place: np.ndarray, firsts: np.ndarray, allowed: pa.Array) -> np.ndarray:
    """Which windows name a run at one of the places that their text's list holds."""
    offsets = allowed.offsets.to_numpy()
    owner = np.repeat(np.arange(len(allowed)), np.diff(offsets))
    held = firsts[owner] + allowed.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return np.isin(place, held)


def _content(words: np.ndarray) -> int:
    """A hash of a run of any length."""
    total = (words * mixed(np.arange(1, len(words) + 1, dtype=np.uint64))).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(words))])).view(np.int64)[0])


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """Documents with surviving windows: their text and the stretches that these cover."""
    length = levels(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            lists = batch.column("alive")
            for first, last in chunks(offsets):
                words = find_words(data, offsets[first : last + 1])
                text, start, place = named_runs(words.hashes, words.firsts, length, window)
                alive = _alive(text, place, words.firsts, lists.slice(first, last - first))
                found: list[list[dict]] = [[] for _ in range(first, last)]
                for t, a, b in _stretches(alive, start, text, window):
                    own = words.hashes[a:b]
                    found[t].append({"start": a - int(words.firsts[t]), "content": _content(own), "words": own.tobytes()})
                columns = [batch.column(c).slice(first, last - first) for c in (*KEY, "text")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(STRETCH))], [*KEY, "text", "stretches"])

    return docs.select(*KEY, "text", "alive").mapInArrow(releasing(run), "_a bigint, _b int, text string, stretches array<struct<start: int, content: bigint, words: binary>>")


def _gathered(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a column of stretches, and where each begins."""
    parts = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _runs_of(stretches: DataFrame, length: int, window: int) -> DataFrame:
    """(content, first, run, place, weight) of the runs that the windows of stretches name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, firsts = _gathered(batch)
            text, _, place = named_runs(hashes, firsts, length, window)
            fresh = np.ones(len(place), bool)
            fresh[1:] = place[1:] != place[:-1]
            text, place = text[fresh], place[fresh]
            runs = shingles(hashes, length)[place].view(np.int64)
            of = lambda name: batch.column(name).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([of("content"), of("first"), pa.array(runs), pa.array(place - firsts[text], pa.int32()), of("weight")], ["content", "first", "run", "place", "weight"])

    return stretches.mapInArrow(releasing(run), "content bigint, first int, run bigint, place int, weight bigint")


def _narrowed(stretches: DataFrame, length: int, window: int) -> DataFrame:
    """The parts of stretches that surviving windows cover; `first` is their place in the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, firsts = _gathered(batch)
            text, start, place = named_runs(hashes, firsts, length, window)
            alive = _alive(text, place, firsts, batch.column("alive"))
            found = list(_stretches(alive, start, text, window))
            owner = pa.array([t for t, _, _ in found], pa.int64())
            base = np.array(batch.column("first").to_pylist(), np.int64)
            columns = [
                batch.column("content").take(owner),
                pa.array([int(base[t] + a - firsts[t]) for t, a, _ in found], pa.int32()),
                batch.column("weight").take(owner),
                pa.array([hashes[a:b].tobytes() for _, a, b in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["content", "first", "weight", "words"])

    return stretches.mapInArrow(releasing(run), "content bigint, first int, weight bigint, words binary")


def _cut(candidates: DataFrame, window: int) -> DataFrame:
    """Words removed and the hash of those kept; `covered` has windows by stretch, null for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, covered in zip(batch.column("text"), batch.column("covered")):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for part in covered.as_py():
                    starts = [0] if part["windows"] is None else part["windows"]
                    size = part["size"] if part["windows"] is None else window
                    at = part["start"] + np.array(starts, np.int64)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + size, -1)
                out = np.cumsum(gone)[:-1] > 0
                removed.append(int(out.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, o in zip(words, out.tolist()) if not o)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*KEY, "n_removed", "kept_sha256"])

    return candidates.select(*KEY, "text", "covered").mapInArrow(releasing(run), "_a bigint, _b int, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    Words are runs of anything but space and 0x09 to 0x0D. Each word that lies in a window of
    `window` words of its document which also starts anywhere else is removed. A null or empty text
    has no words; repeated rows repeat each other; a null doc_id stays null; no rows give no rows.
    Only doc_id and text are read. Equal 64-bit hashes of runs are taken as equal runs.
    """
    keyed = _with_key(docs)
    described = materialise(_described(keyed, window), "substring-runs")
    pairs = described.select(*KEY, F.explode(F.arrays_zip("runs", "places")).alias("_pair"))
    rows = pairs.select(*KEY, F.col("_pair.runs").alias("run"), F.col("_pair.places").alias("place"), F.lit(1).alias("weight"))
    alive = materialise(_repeated(rows, KEY), "substring-places")
    # Texts without a surviving window are not shuffled, but for a few.
    held = keyed.filter(known_to(alive, "_a", "_a")).join(alive, KEY)
    candidates = materialise(_candidates(held, window), "substring-candidates")
    held = candidates.select(*KEY, F.explode("stretches").alias("_s")).select(*KEY, "_s.*")
    stretches = materialise(
        held.groupBy("content").agg(F.count("*").alias("weight"), F.first("words").alias("words")).withColumn("first", F.lit(0)),
        "substring-stretches",
    )
    for length in levels(window)[1:] or [window]:
        rows = _runs_of(stretches, length, window)
        alive = _repeated(rows, ["content", "first"])
        if length == window:
            break
        # A stretch that is there twice has no window to lose.
        again = stretches.filter("weight > 1").select("content", "first", "weight", "words")
        single = stretches.filter("weight = 1").join(alive, ["content", "first"])
        stretches = materialise(_narrowed(single, length, window).unionByName(again), "substring-stretches")
    windows = alive.select("content", F.transform("alive", lambda p: p + F.col("first")).alias("alive"))
    windows = windows.groupBy("content").agg(F.flatten(F.collect_list("alive")).alias("windows"))
    twice = stretches.filter("weight > 1").select("content", F.lit(None).cast("array<int>").alias("windows")).distinct()
    lost = materialise(windows.unionByName(twice), "substring-windows")
    found = join_unique(held.select(*KEY, "start", "content", (F.octet_length("words") / 8).cast("int").alias("size")), lost, "content")
    covered = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size", "windows")).alias("covered"))
    cut = _cut(candidates.select(*KEY, "text").join(covered, KEY), window).dropDuplicates(KEY)
    return described.select("doc_id", *KEY, "n_words", "whole").join(cut, KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
