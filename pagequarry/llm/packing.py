"""Packing documents into sequences by the sum-of-squares rule.

Each task packs the documents it reads, so nothing is shuffled and a document of any length is
packed where it is read. A level array counts the open sequences by how full they are; a document
goes where the sum of the squared counts grows least. What is left open at the end of a task is cut
again so that at most one sequence of the task is not full.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pagequarry.llm.words import WHITE, chunks, releasing, text_buffer

WINDOW = 2048
END_ID = 1
# Open sequences of a task; beyond this they are cut into full ones, so memory stays bounded.
MOST_OPEN = 4096
# Bits of a sequence number that count within a task.
TASK_SHIFT = 40
# Words whose ids a worker keeps, besides the older ones of these that came again.
CACHED_WORDS = 500_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes; each distinct word is encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in order.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._again: set[bytes] = set()

    def _learn(self, words: list[bytes]) -> None:
        found = self._tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = 4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1))
        ends = ends.tolist()
        self._known.update(zip(words, [ids[a:b] for a, b in zip(ends, ends[1:])]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words = [text.split() for text in _apart(texts)]
        fresh = set().union(*words)
        new = fresh.difference(self._known)
        self._again.update(fresh.difference(new))
        kept = [word for word in new if word in self._older]
        self._known.update(zip(kept, map(self._older.__getitem__, kept)))
        self._again.update(kept)
        new.difference_update(kept)
        new = list(new)
        for first in range(0, len(new), 20_000):
            self._learn(new[first : first + 20_000])
        ids = [b"".join(map(self._known.__getitem__, each)) for each in words]
        if len(self._known) > CACHED_WORDS:
            # Most words come once: only those that came again are kept for the next round.
            self._older = {word: self._known[word] for word in self._again}
            self._known, self._again = {}, set()
        return ids


def _apart(texts: list[bytes]) -> list[bytes]:
    """The texts with A to Z in lower case, and a space before the ASCII marks that end a word, where
    a letter of Latin or a digit is before them. The tokenizer does both itself, so the ids stay; far
    fewer words are distinct. Texts that may hold a special token in clear are left as they are.
    """
    joined = b" " + b" ".join(texts) + b" "
    if b"<|" in joined:
        return texts
    data = _LOWER[np.frombuffer(joined, np.uint8)]
    mark = _MARK[data]
    starts = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
    ends = np.flatnonzero(mark[:-1] & ~mark[1:]) + 1  # a run of marks ends before a space at last
    before = data[starts - 1]
    letter = _ALNUM[before] | _LATIN[before] & (data[starts - 2] == 0xC3)
    cuts = starts[letter & WHITE[data[ends]]]
    places = 1 + np.cumsum([0] + [len(text) + 1 for text in texts])
    places += np.searchsorted(cuts, places)
    spaced = np.insert(data, cuts, 32).tobytes()
    return [spaced[a : b - 1] for a, b in zip(places.tolist(), places[1:].tolist())]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])
_MARK = np.array([32 < c < 127 and not chr(c).isalnum() for c in range(256)])
# Second bytes of the letters from U+00C0 to U+00FF: all but the signs for times and division.
_LATIN = np.array([0x80 <= c <= 0xBF and c not in (0x97, 0xB7) for c in range(256)])


@cache
def shared_encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker, with the words of its earlier tasks."""
    return WordEncoder(path)


class LevelArray:
    """Open sequences of one task, by fill level."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: defaultdict[int, list[list]] = defaultdict(list)
        self.rows: list[tuple] = []
        self._next = first_sequence

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new sequence, that keeps the sum of squared counts least.

        Ties go to the fuller level. Empty and full sequences are not counted.
        """
        here = self.counts[1 : self.window - size + 1]
        change = 2 * (self.counts[1 + size : self.window + 1] - here) + 2
        if not len(change):
            return 0
        change[-1] -= 1
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * self.counts[size] + 1 else 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            self._emit([(doc_id, start, ids[4 * start : 4 * (start + self.window)], total)])
        size = total - whole
        if not size:
            return
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.counts[level] -= 1
        pieces.append((doc_id, whole, ids[4 * whole :], total))
        if level + size == self.window:
            self._emit(pieces)
        else:
            self.open[level + size].append(pieces)
            self.counts[level + size] += 1
            if self.counts.sum() > MOST_OPEN:
                self.close(keep_last=True)

    def close(self, keep_last: bool = False) -> None:
        """Cut the open sequences into full ones and at most one that is not."""
        left = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        self.open.clear()
        self.counts[:] = 0
        held: list[tuple] = []
        room = self.window
        for doc_id, start, ids, total in left:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                held.append((doc_id, start, part, total))
                start += len(part) // 4
                room -= len(part) // 4
                if not room:
                    self._emit(held)
                    held, room = [], self.window
        if held and keep_last:
            self.open[self.window - room].append(held)
            self.counts[self.window - room] += 1
        elif held:
            self._emit(held)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self._next, offset))
            offset += len(ids) // 4
        self._next += 1


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of the documents (doc_id, text) and their places in sequences of `window` ids.

    A document is the ids of its text followed by `end_id`. A null or empty text is that id alone;
    a null doc_id stays null; repeated rows are packed each time; no rows give no rows. Only doc_id
    and text are read, so other columns may have any name. Sequences are numbered by task.
    """
    path = tokenizer or default_tokenizer()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        encoder = shared_encoder(path)
        levels = LevelArray(window, TaskContext.get().partitionId() << TASK_SHIFT)
        end = np.array([end_id], "<u4").tobytes()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*levels.rows)) or [()] * len(names)
            levels.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_buffer(batch.column(1))
            for first, last in chunks(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
                for doc_id, encoded in zip(ids[first:last], encoder.encode(texts)):
                    levels.add(doc_id, encoded + end)
                yield rows()
        levels.close()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
