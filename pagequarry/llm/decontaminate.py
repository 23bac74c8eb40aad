"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Documents are cut into overlapping passages long enough to hold any item of the index. An item's
weights are its BM25 weights divided by their sum, so a passage's score is the share of the item that
it covers. What is found is scored again in windows that the item's own length alone decides.
Items lie in blocks of BLOCK_ITEMS; each posting list has the largest weight of every block and of
the whole list. A passage is skipped when the list maxima of its terms cannot reach the threshold,
only terms beyond the pivot open blocks, a block is skipped when its own maxima cannot reach the
threshold, and the items of the others are scored. Items that are found count when both their
question and their answer overlap with the passage. All passages of a batch go through each of
these steps together.

Items of few words, or with a part without words, are postings of the same kind. They count where all
their terms are in a passage and stand there as one run; the symbols are terms as well where a part
consists of these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.words import NOT_ALNUM, UNSPACED, WHITE, chunks, expand, find_words, releasing, shingles, text_buffer, Words
from pagequarry.session import materialise

K1, B = 1.2, 0.75
THRESHOLD = 0.5
# The share of an item that all its terms make up, but for rounding.
ALL_TERMS = 1 - 1e-6
LEAST_OVERLAP = 0.5
OVERLAP_WORDS = 3
BLOCK_ITEMS = 16
# Items of fewer words are too short for shares: they must be there whole.
LEAST_ITEM_WORDS = 5
LEAST_STRIDE = 64
# Bytes of texts whose words and passages are held at a time.
TEXT_BYTES = 1 << 18
# Bytes of item text that are indexed and sent at a time.
ROUND_BYTES = 8 << 20


_OWN = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
PIECE = re.compile(rf"[{_OWN}]|[^\s{_OWN}]+")
SENTENCE_END = re.compile(r"(?<=[.?!:])\s+|(?<=[\u3002\uff1f\uff01\uff1a])\s*")


def _found(data: np.ndarray, offsets: np.ndarray, symbols: bool = False) -> Words:
    """Words, and each ASCII symbol as a word of its own if asked for."""
    if symbols:
        return find_words(data, offsets, lower=True, unspaced=True, alone=NOT_ALNUM & ~WHITE)
    return find_words(data, offsets, lower=True, white=NOT_ALNUM, unspaced=True)


def _words(texts: list[str], symbols: bool = False) -> Words:
    return _found(*text_buffer(pa.array(texts, pa.string())), symbols)


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last sentence, or the last third where there is but one."""
    parts = [p for p in SENTENCE_END.split(text.strip()) if len(PIECE.findall(p)) >= OVERLAP_WORDS]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = PIECE.findall(text)
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _grams(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Runs of words, as long as the words allow, and their length."""
    length = min(OVERLAP_WORDS, max(1, len(hashes)))
    return shingles(hashes, length), length


def _holds(words: np.ndarray, run: np.ndarray) -> bool:
    at = np.arange(len(words) - len(run) + 1) if len(words) >= len(run) else np.zeros(0, np.int64)
    for k, word in enumerate(run):
        at = at[words[at + k] == word]
        if not len(at):
            return False
    return bool(len(at))


def _counts_of(frequency: tuple[np.ndarray, np.ndarray], terms: np.ndarray) -> np.ndarray:
    """In how many items each term is; none for terms that are not listed."""
    names, counts = frequency
    if not len(names):
        return np.zeros(len(terms))
    place = np.minimum(np.searchsorted(names, terms), len(names) - 1)
    return np.where(names[place] == terms, counts[place], 0.0)


class Found(NamedTuple):
    text: int
    item: int
    score: float
    question: float
    answer: float


class Index:
    """Block-max postings of some items, with statistics over all items that are found by shares.

    Those marked `whole` are found as runs of all their terms; `symbols` are terms if asked for.
    """

    def __init__(
        self,
        items: list[tuple[int, str]],
        frequency: tuple[np.ndarray, np.ndarray],
        count: int,
        mean_words: float,
        whole: np.ndarray | None = None,
        symbols: bool = False,
    ) -> None:
        self.ids = [i for i, _ in items]
        self.symbols = symbols
        self.whole = np.zeros(len(items), bool) if whole is None else np.asarray(whole, bool)
        self.parts = []
        for _, text in items:
            words = _words(list(question_and_answer(text)))
            cut = words.firsts[1]
            self.parts.append([_grams(h) for h in (words.hashes[:cut], words.hashes[cut:])])
        words = _words([text for _, text in items], symbols)
        sizes = np.diff(words.firsts)
        self.runs = {int(n): words.hashes[words.firsts[n] : words.firsts[n + 1]] for n in np.flatnonzero(self.whole)}
        # An item is scored in windows of twice its stride. Passages are these windows, or hold them.
        self.strides = np.maximum(LEAST_STRIDE, sizes)
        most = int(self.strides.max(initial=LEAST_STRIDE))
        self.stride = most if (self.strides == most).all() else 2 * most
        owner = np.repeat(np.arange(len(items)), sizes)
        self.terms, term = np.unique(words.hashes, return_inverse=True)
        pairs, times = np.unique(term * len(items) + owner, return_counts=True)
        term, owner = pairs // max(1, len(items)), pairs % max(1, len(items))
        held = _counts_of(frequency, self.terms)
        rarity = np.log(1 + (count - held + 0.5) / (held + 0.5))
        weights = rarity[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[owner] / (mean_words or 1.0)))
        weights = weights / np.bincount(owner, weights, len(items))[owner]
        order = np.argsort(owner, kind="stable")
        self.own_term, self.own_weight = term[order], weights[order]
        self.own_first = np.searchsorted(owner[order], np.arange(len(items) + 1))
        # Postings by term and item; a block's are neighbours.
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.slots, self.weights = owner % BLOCK_ITEMS, weights
        key = term * self.blocks + owner // BLOCK_ITEMS
        self.keys, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key))
        self.block_most = np.maximum.reduceat(weights, first) if len(key) else weights
        self.term_first = np.searchsorted(self.keys, np.arange(len(self.terms) + 1) * self.blocks)
        self.list_most = np.maximum.reduceat(self.block_most, self.term_first[:-1]) if len(key) else weights

    def passages(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (passage, term) pairs in order, and each passage's text and first word.

        Passage j of a text has the words from j * stride to (j + 2) * stride.
        """
        counts = np.diff(words.firsts)
        number = np.maximum(1, -(-counts // self.stride) - 1)
        base = np.concatenate([[0], np.cumsum(number)])
        term = np.searchsorted(self.terms, words.hashes)
        term[term == len(self.terms)] = 0
        at = np.flatnonzero(self.terms[term] == words.hashes)
        text = np.searchsorted(words.firsts, at, "right") - 1
        half = (at - words.firsts[text]) // self.stride
        later, earlier = half < number[text], half > 0
        passage = np.concatenate([(base[text] + half)[later], (base[text] + half - 1)[earlier]])
        pairs = np.unique(passage * len(self.terms) + np.concatenate([term[at][later], term[at][earlier]]))
        of_text = np.repeat(np.arange(len(counts)), number)
        first_word = words.firsts[of_text] + (np.arange(base[-1]) - base[of_text]) * self.stride
        return pairs // len(self.terms), pairs % len(self.terms), of_text, first_word

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages, items and scores for every score of at least the threshold."""
        slack = threshold - 1e-9
        most = self.list_most[term]
        order = np.lexsort((most, passage))
        passage, term, most = passage[order], term[order], most[order]
        names, first = np.unique(passage, return_index=True)
        ends = np.append(first[1:], len(passage))
        total = np.concatenate([[0.0], np.cumsum(most)])
        # What this term and the weaker ones of its passage could add up to at most.
        reach = total[1:] - np.repeat(total[first], ends - first)
        opens = np.flatnonzero(reach >= slack)
        owner, posting = expand(self.term_first[term[opens]], np.diff(self.term_first)[term[opens]])
        group = np.searchsorted(names, passage[opens])[owner]
        pairs = np.unique(group * self.blocks + self.keys[posting] % self.blocks)
        group, block = pairs // self.blocks, pairs % self.blocks
        owner, element = expand(first[group], (ends - first)[group])
        key = term[element] * self.blocks + block[owner]
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        there = self.keys[place] == key
        owner, place = owner[there], place[there]
        bound = np.bincount(owner, self.block_most[place], len(pairs))
        kept = (bound >= slack)[owner]
        owner, place = owner[kept], place[kept]
        who, posting = expand(self.first[place], np.diff(self.first)[place])
        slot = owner[who] * BLOCK_ITEMS + self.slots[posting]
        cells, cell = np.unique(slot, return_inverse=True)
        scores = np.bincount(cell, self.weights[posting], len(cells))
        item = block[cells // BLOCK_ITEMS] * BLOCK_ITEMS + cells % BLOCK_ITEMS
        good = scores >= np.where(self.whole[item], ALL_TERMS, slack)
        return names[group[cells[good] // BLOCK_ITEMS]], item[good], scores[good]

    def find(self, data: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD, least: float = LEAST_OVERLAP) -> list[Found]:
        return self.find_in(_found(data, offsets, self.symbols), threshold, least)

    def windows(self, item: int, first: int, text_first: int, text_end: int, score: float) -> Iterator[tuple[int, int, float | None]]:
        """First word, end and, if known, score of the item's windows in the passage from `first`."""
        stride = int(self.strides[item])
        if stride == self.stride:
            yield first, min(first + 2 * stride, text_end), score
            return
        count = max(1, -(-(text_end - text_first) // stride) - 1)
        for j in range(-(-(first - text_first) // stride), count):
            start = text_first + j * stride
            end = min(start + 2 * stride, text_end)
            if end > first + 2 * self.stride:
                return
            yield start, end, None

    def find_in(self, words: Words, threshold: float = THRESHOLD, least: float = LEAST_OVERLAP) -> list[Found]:
        """For every text and item: the best window that passes both tests."""
        if not len(self.terms):
            return []
        passage, term, of_text, first_word = self.passages(words)
        best: dict[tuple[int, int], Found] = {}
        for p, item, reached in zip(*self.search(passage, term, threshold)):
            text = int(of_text[p])
            if self.whole[item]:
                if (text, int(item)) not in best:
                    first = int(first_word[p])
                    if _holds(words.hashes[first : min(first + 2 * self.stride, int(words.firsts[text + 1]))], self.runs[int(item)]):
                        best[text, int(item)] = Found(text, int(item), 1.0, 1.0, 1.0)
                continue
            mine = slice(self.own_first[item], self.own_first[item + 1])
            for start, end, score in self.windows(int(item), int(first_word[p]), int(words.firsts[text]), int(words.firsts[text + 1]), float(reached)):
                own = words.hashes[start:end]
                if score is None:
                    score = float(self.own_weight[mine][np.isin(self.terms[self.own_term[mine]], own)].sum())
                    if score < threshold - 1e-9:
                        continue
                question, answer = (float(np.isin(part, shingles(own, size)).mean()) if len(part) else 0.0 for part, size in self.parts[item])
                if question >= least and answer >= least:
                    found = Found(text, int(item), score, question, answer)
                    if (text, found.item) not in best or found[2:] > best[text, found.item][2:]:
                        best[text, found.item] = found
        return list(best.values())


class Round(NamedTuple):
    """What is searched for at a time: indexes of items of similar length."""

    indexes: list[Index]

    def find(self, data: np.ndarray, offsets: np.ndarray, threshold: float) -> list[tuple[int, int, float, float, float]]:
        """Texts, item ids, scores and both overlaps."""
        found = []
        for symbols in (False, True):
            own = [index for index in self.indexes if index.symbols == symbols]
            words = _found(data, offsets, symbols) if own else None
            for index in own:
                found += [(f.text, index.ids[f.item], *f[2:]) for f in index.find_in(words, threshold)]
        return found


SHARES, WHOLE, SYMBOLS = range(3)


def _ways(texts: list[str]) -> list[int | None]:
    """How each item is searched for; None for one of no character, or of one letter or digit."""
    sizes = np.diff(_words(texts).firsts)
    parts = [question_and_answer(t) for t in texts]
    by_part = np.diff(_words([p for pair in parts for p in pair]).firsts).reshape(-1, 2)
    ways = []
    for text, pair, size, held in zip(texts, parts, sizes, by_part):
        if not text.strip() or re.fullmatch("[A-Za-z0-9]", text.strip()):
            ways.append(None)
        elif not size or any(p.strip() and not n for p, n in zip(pair, held)):
            ways.append(SYMBOLS)
        else:
            ways.append(SHARES if size >= LEAST_ITEM_WORDS and held.all() else WHOLE)
    return ways


def indexes(items: DataFrame, least_words: int = 1) -> tuple[int, Iterator[Round]]:
    """How many rounds of bounded size the items (item_id, text) make, and these one by one: indexes
    with common statistics.

    Items without a text, of one letter or digit, or of fewer than `least_words` words or symbols are
    not searched for.
    """
    rows = materialise(items.filter("text is not null").select("item_id", "text"), "benchmark-items")
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-held // ROUND_BYTES))

    def part(k: int) -> tuple[list[tuple[int, str]], list[int | None]]:
        found = rows.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).orderBy("item_id", "text").collect()
        texts = [r.text for r in found]
        ways = _ways(texts)
        if least_words > 1:
            words, symbols = (np.diff(_words(texts, s).firsts) for s in (False, True))
            ways = [w if (m if w == SYMBOLS else n) >= least_words else None for w, n, m in zip(ways, words, symbols)]
        return [(r.item_id, r.text) for r in found], ways

    terms, held, count, total = np.zeros(0, np.uint64), np.zeros(0), 0, 0
    kept = part(0) if rounds == 1 else None
    for k in range(rounds):
        some, ways = kept or part(k)
        own = [item for item, way in zip(some, ways) if way == SHARES]
        words = _words([text for _, text in own])
        sizes = np.diff(words.firsts)
        owner = np.repeat(np.arange(len(own)), sizes)
        names, place = np.unique(words.hashes, return_inverse=True)
        once = np.unique(place * max(1, len(own)) + owner) // max(1, len(own))
        every = np.concatenate([terms, names])
        add = np.concatenate([held, np.bincount(once, minlength=len(names))])
        terms, place = np.unique(every, return_inverse=True)
        held = np.bincount(place, add, len(terms))
        count, total = count + len(own), total + int(sizes.sum())
    mean = total / max(1, count)

    def group(some: list[tuple[int, str]], ways: list[int | None], symbols: bool) -> list[Index]:
        own = [n for n, way in enumerate(ways) if way is not None and (way == SYMBOLS) == symbols]
        sizes = np.diff(_words([some[n][1] for n in own], symbols).firsts)
        # Strides within a factor of two, so that passages stay near the windows of each item.
        level = np.ceil(np.log2(np.maximum(1, sizes / LEAST_STRIDE)))
        built = []
        for k in np.unique(level):
            these = [own[n] for n in np.flatnonzero(level == k)]
            built.append(Index([some[n] for n in these], (terms, held), count, mean, np.array([ways[n] != SHARES for n in these]), symbols))
        return built

    def one_by_one() -> Iterator[Round]:
        for k in range(rounds):
            some, ways = kept or part(k)
            built = [*group(some, ways, False), *group(some, ways, True)]
            if built:
                yield Round(built)

    return rounds, one_by_one()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every item in every document.

    A null or empty text holds no item; a null doc_id stays null; repeated rows are answered each
    time; no documents or no items give no rows. Other columns are not read.
    """
    found, (rounds, every) = None, indexes(items)
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    names = [part.split()[0] for part in schema.split(", ")]
    for index in every:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @releasing
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                data, offsets = text_buffer(batch.column(1))
                rows = []
                for first, last in chunks(offsets, TEXT_BYTES):
                    rows += [(ids[first + text], *rest) for text, *rest in shared.value.find(data, offsets[first : last + 1], threshold)]
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        if rounds > 1:  # one index alive at a time
            part = materialise(part, "leaks")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least_words: int = 1) -> DataFrame:
    """The rows of docs, all columns, that hold no item of `least_words` words and more.

    A row with a null or empty text stays; repeated rows stay or go alike; without items all rows
    stay, and no rows give no rows. Other columns are passed on, whatever their names.
    """
    place, schema = docs.columns.index("text"), docs.schema
    rounds, every = indexes(items, least_words)
    for index in every:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @releasing
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffer(batch.column(place))
                kept = np.ones(batch.num_rows, bool)
                for first, last in chunks(offsets, TEXT_BYTES):
                    kept[[first + text for text, *_ in shared.value.find(data, offsets[first : last + 1], threshold)]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(run, schema)
        if rounds > 1:
            docs = materialise(docs, "without-leaks")
            shared.unpersist()
    return docs
