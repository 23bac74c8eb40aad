"""Secrets: patterns find labelled credentials, automata inferred from them score every candidate.

The credentials that the base patterns find are labelled by their kind. For each kind a prefix tree
of their character classes is folded into a probabilistic automaton: two states are merged while
their outgoing and final frequencies, and those of what follows, agree within a Hoeffding bound.
Every token outside the base spans is then scored: how likely it is under an automaton, next to
labelled values of the kind and to ordinary text, as pairs of characters in the rest of the
documents. It is added to the spans when it is no less likely than labelled values can be, and so
much likelier than as ordinary text as secrets are rarer than tokens. Long tokens of letters and
digits stand out by themselves: for these the rarity does not count, and a high gain per character
over independent ones is enough.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.words import chunks, releasing, text_buffer
from pagequarry.session import materialise

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PATTERNS = {
    "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
KINDS = (*PATTERNS, "format")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# All tokens: a dot is part of one only between other characters of it.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
LEAST_TOKEN = 6
HAS_DIGIT, HAS_LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
# The automaton of a kind is fitted on so many distinct values, those of the smallest hash, none
# longer than LONGEST_SAMPLE.
SAMPLES_PER_KIND = 1000
LONGEST_SAMPLE = 200
# Confidence of the merge test, and the gain per character that makes a candidate a secret by itself.
ALPHA = 0.05
LEAST_GAIN = 0.7
# Logarithm of how much likelier than ordinary text a token of a learned format must be.
LEAST_ODDS = 7.0
# A token fits a format down to the least labelled gain, or so many deviations below their mean.
DEVIATIONS = 5.0
CLASSES = {**dict.fromkeys("0123456789", ("d", 10)), **dict.fromkeys("abcdef", ("a", 6)), **dict.fromkeys("ghijklmnopqrstuvwxyz", ("l", 20)), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("U", 26))}
ALPHABET = 67
SMOOTHING = 0.01
# Characters of tokens; all other bytes are one more symbol.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-."
PLACES = {c: n for n, c in enumerate(SYMBOLS)}
OTHER = len(SYMBOLS)
_CODES = np.full(256, OTHER, np.int64)
_CODES[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(OTHER)
# Tokens up to this length are scored together, longer ones each for itself.
LONG_TOKEN = 1000
# Weight of a character's own frequency among those that follow another one.
PRIOR_PAIRS = 5.0


class Hit(NamedTuple):
    start: int
    rank: int
    end: int
    value: str


def base_hits(text: str) -> list[Hit]:
    """Spans of the base patterns, in order of start and kind; value is the credential itself."""
    hits = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        hits += [Hit(m.start(), 0, m.end(), m[2]) for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        hits += [Hit(m.start(), 1, m.end(), m[0]) for m in PATTERNS["access"].finditer(text) if len(m[0]) >= 20]
    hits += [Hit(m.start(), 2, m.end(), m[0]) for m in PATTERNS["hex"].finditer(text)]
    return sorted(hits)


def candidates(text: str, hits: list[Hit]) -> list[Hit]:
    """Other long tokens of letters and digits that touch no base span."""
    found, k = [], 0
    for m in CANDIDATE.finditer(text):
        while k < len(hits) and hits[k].end <= m.start():
            k += 1
        if any(h.start < m.end() and h.end > m.start() for h in hits[k : k + 3]):
            continue
        if HAS_DIGIT.search(m[0]) and HAS_LETTER.search(m[0]):
            found.append(Hit(m.start(), 3, m.end(), m[0]))
    return found


class _State:
    """Visits, ends, and for each symbol the following state with the number of times it was taken."""

    __slots__ = ("visits", "ends", "next")

    def __init__(self) -> None:
        self.visits = self.ends = 0
        self.next: dict[str, list] = {}


class Automaton:
    """A probabilistic automaton over character classes, by merging states of a prefix tree."""

    def __init__(self, samples: list[str], alpha: float = ALPHA) -> None:
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.start = _State()
        for sample in samples:
            state = self.start
            state.visits += 1
            for char in sample:
                edge = state.next.setdefault(CLASSES.get(char, (char, 1))[0], [None, 0])
                edge[0] = edge[0] or _State()
                edge[1] += 1
                state = edge[0]
                state.visits += 1
            state.ends += 1
        self.states = self._merge()

    def _close(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) <= self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, kept: _State, tree: _State) -> bool:
        """The second state is the root of a tree, so the walk ends."""
        todo = [(kept, tree)]
        while todo:
            p, q = todo.pop()
            if not self._close(p.ends, p.visits, q.ends, q.visits):
                return False
            for symbol in p.next.keys() | q.next.keys():
                (r, a), (s, b) = p.next.get(symbol, (None, 0)), q.next.get(symbol, (None, 0))
                if not self._close(a, p.visits, b, q.visits):
                    return False
                if r and s:
                    todo.append((r, s))
        return True

    def _fold(self, into: _State, tree: _State) -> None:
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            p.visits += q.visits
            p.ends += q.ends
            for symbol, (child, n) in q.next.items():
                if symbol in p.next:
                    p.next[symbol][1] += n
                    todo.append((p.next[symbol][0], child))
                else:
                    p.next[symbol] = [child, n]

    def _merge(self) -> int:
        kept = [self.start]
        while True:
            done = {id(state) for state in kept}
            edge = next((e for p in kept for _, e in sorted(p.next.items()) if id(e[0]) not in done), None)
            if edge is None:
                return len(kept)
            tree = edge[0]
            for state in kept:
                if self._compatible(state, tree):
                    edge[0] = state
                    self._fold(state, tree)
                    break
            else:
                kept.append(tree)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By state and place in SYMBOLS: the following state, and the gain of that character."""
        states, place = [self.start], {id(self.start): 0}
        for state in states:
            for child, _ in state.next.values():
                if id(child) not in place:
                    place[id(child)] = len(states)
                    states.append(child)
        after, gains = np.zeros((len(states), OTHER), np.int32), np.zeros((len(states), OTHER))
        for n, state in enumerate(states):
            for at, char in enumerate(SYMBOLS):
                child, gains[n, at] = self._step(state, char)
                after[n, at] = place[id(child)]
        return after, gains

    def _step(self, state: _State, char: str) -> tuple[_State, float]:
        symbol, size = CLASSES.get(char, (char, 1))
        after, n = state.next.get(symbol, (None, 0))
        spare = SMOOTHING * state.visits + 1
        return after or self.start, math.log((n / size * ALPHABET + spare) / (state.visits + spare))

    def gain(self, value: str) -> float:
        """Mean gain per character, in nats, over independent characters.

        Part of every state's visits goes to all characters alike; after one that the state does
        not know, the format begins anew.
        """
        state, total = self.start, 0.0
        for char in value:
            state, more = self._step(state, char)
            total += more
        return total / max(1, len(value))


class Ordinary:
    """Ordinary text: how often each character follows another inside a token.

    A token in capitals is as ordinary as in small letters.
    """

    def __init__(self, pairs: np.ndarray) -> None:
        inside = pairs[:, :OTHER].astype(np.float64)
        self.words = float(inside[OTHER].sum())
        alone = inside.sum(axis=0) + 1
        alone /= alone.sum()
        own = (inside + PRIOR_PAIRS * alone) / (inside.sum(axis=1, keepdims=True) + PRIOR_PAIRS)
        self.logs = np.log(own).tolist()

    def _sum(self, value: str) -> float:
        total, before = 0.0, OTHER
        for char in value:
            at = PLACES[char]
            total += self.logs[before][at]
            before = at
        return total

    def likelihood(self, value: str) -> float:
        return max(self._sum(value), self._sum(value.lower())) if value.isupper() else self._sum(value)


def _pairs(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes[:-1] * (OTHER + 1) + codes[1:], minlength=(OTHER + 1) ** 2)


def _sent(seen: np.ndarray) -> pa.RecordBatch:
    pairs = np.flatnonzero(seen)
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(seen[pairs])], ["pair", "times"])


def ordinary(docs: DataFrame, found: DataFrame) -> Ordinary:
    """From every text less what was found in it; a task sends one row for each pair that it has seen."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((OTHER + 1) ** 2, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for first, last in chunks(offsets):
                seen += _pairs(_CODES[data[offsets[first] : offsets[last]]])
        yield _sent(seen)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((OTHER + 1, OTHER + 1), np.int64)
        for batch in batches:
            for hits in batch.column(0).to_pylist():
                own, upto = [], 0
                for end, value in sorted((h["end"], h["value"]) for h in hits):
                    own.append(value[max(0, upto - end + len(value)) :])
                    upto = max(upto, end)
                data = np.frombuffer("\n".join(["", *own, ""]).encode(), np.uint8)
                seen -= _pairs(_CODES[data]).reshape(seen.shape)
        # What stands before and after a value is ordinary.
        seen[OTHER], seen[:, OTHER] = 0, 0
        yield _sent(seen.ravel())

    schema, total = "pair bigint, times bigint", np.zeros((OTHER + 1) ** 2)
    both = docs.select("text").mapInArrow(texts, schema).unionByName(found.filter("size(hits) > 0").select("hits").mapInArrow(values, schema))
    for r in both.groupBy("pair").agg(F.sum("times").alias("times")).collect():
        total[r.pair] = max(0, r.times)
    return Ordinary(total.reshape(OTHER + 1, OTHER + 1))


class Judge(NamedTuple):
    """Automata by kind, the gain that its format has at least, ordinary text, and the logarithm of
    how much likelier than that a token has to be."""

    models: dict[str, Automaton]
    floors: dict[str, float]
    plain: Ordinary
    odds: float
    tables: dict[str, tuple[np.ndarray, np.ndarray]]

    def _fits(self, gains: dict[str, float], value: str, odds: float) -> bool:
        fits = [g for kind, g in gains.items() if g >= self.floors[kind]]
        return bool(fits) and len(value) * (max(fits) - math.log(ALPHABET)) >= self.plain.likelihood(value) + odds

    def secret(self, value: str, least_gain: float) -> bool:
        """Of a long token of letters and digits."""
        gains = {kind: m.gain(value) for kind, m in self.models.items()}
        return max(gains.values(), default=0.0) >= least_gain or self._fits(gains, value, LEAST_ODDS)

    def likely(self, value: str) -> bool:
        """Of any token."""
        return self._fits({kind: m.gain(value) for kind, m in self.models.items()}, value, self.odds)

    def near(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The tokens that `likely` may hold for; the sums differ by rounding only.

        A token in capitals may be more ordinary than this takes it for, never less.
        """
        if not len(starts) or not self.models:
            return np.zeros(0, np.int64)
        sizes = ends - starts
        short, longer = np.flatnonzero(sizes <= LONG_TOKEN), np.flatnonzero(sizes > LONG_TOKEN)
        short = short[np.argsort(-sizes[short], kind="stable")]
        starts, sizes = starts[short], sizes[short]
        logs = np.array(self.plain.logs)
        usual = np.zeros(len(short))
        gains = {kind: np.zeros(len(short)) for kind in self.models}
        states = {kind: np.zeros(len(short), np.int32) for kind in self.models}
        before = np.full(len(short), OTHER)
        for step in range(int(sizes.max(initial=0))):
            count = int(np.searchsorted(-sizes, -step, "left"))  # tokens longer than step
            at = codes[starts[:count] + step]
            usual[:count] += logs[before[:count], at]
            before[:count] = at
            for kind, (after, gain) in self.tables.items():
                state = states[kind][:count]
                gains[kind][:count] += gain[state, at]
                states[kind][:count] = after[state, at]
        slack = 1e-6 * sizes
        good = np.zeros(len(short), bool)
        for kind, own in gains.items():
            good |= (own + slack >= self.floors[kind] * sizes) & (own - sizes * math.log(ALPHABET) + slack >= usual + self.odds)
        return np.sort(np.concatenate([short[good], longer]))


def judge(docs: DataFrame, found: DataFrame) -> Judge:
    """Fitted on all texts and what was found in them.

    Any token has to be likelier than ordinary text by LEAST_ODDS more than what tokens outnumber
    labelled values by: if ordinary text were as the pairs say, there would be one false span for
    a thousand labelled ones.
    """
    models, floors = {}, {}
    for kind, values in labelled(found).items():
        models[kind] = Automaton(values)
        gains = np.array([models[kind].gain(v) for v in values])
        floors[kind] = float(min(gains.min(), gains.mean() - DEVIATIONS * gains.std()))
    plain = ordinary(docs, found)
    known = found.agg(F.sum(F.size(F.filter("hits", lambda h: h["rank"] < 3))).alias("n")).first()["n"] or 0
    odds = LEAST_ODDS + math.log(max(1.0, plain.words / max(1, known)))
    return Judge(models, floors, plain, odds, {kind: m.tables() for kind, m in models.items()})


_DOT = ord(".")


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bytes, and starts and ends of all tokens of LEAST_TOKEN and more, within the
    texts data[offsets[i]:offsets[i + 1]]; places count from offsets[0]."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    codes = _CODES[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (codes != OTHER) & (data != _DOT)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    dots = np.flatnonzero(data == _DOT)
    dots = dots[~breaks[dots] & ~breaks[dots + 1] & inside[dots] & inside[dots + 2]]
    inside[dots + 1] = True
    here = inside[1:-1]
    starts = np.flatnonzero(here & (~inside[:-2] | breaks[:-1]))
    ends = np.flatnonzero(here & (~inside[2:] | breaks[1:])) + 1
    enough = ends - starts >= LEAST_TOKEN
    return codes, starts[enough], ends[enough]


def proposals(column: pa.Array, judged: Judge) -> Iterator[list[tuple[int, int]]]:
    """For every text the tokens, as code points, that may be secrets."""
    data, offsets = text_buffer(column)
    for first, last in chunks(offsets):
        bounds = offsets[first : last + 1]
        codes, starts, ends = tokens(data, bounds)
        near = judged.near(codes, starts, ends)
        found: list[list[tuple[int, int]]] = [[] for _ in range(first, last)]
        if len(near):
            own = data[bounds[0] : bounds[-1]]
            points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            begin = bounds - bounds[0]
            text = np.searchsorted(begin, starts[near], "right") - 1
            base = points[begin[text]]
            for t, a, b in zip(text.tolist(), (points[starts[near]] - base).tolist(), (points[ends[near]] - base).tolist()):
                found[t].append((a, b))
        yield from found


def _free(spans: list[tuple[int, int]], hits: list[Hit]) -> Iterator[tuple[int, int]]:
    """The spans that touch no hit; both in order of start."""
    k, reach = 0, 0
    for a, b in spans:
        while k < len(hits) and hits[k].start < b:
            reach = max(reach, hits[k].end)
            k += 1
        if reach <= a:
            yield a, b


def formats(text: str, base: list[Hit], spans: list[tuple[int, int]], judged: Judge, least_gain: float) -> list[Hit]:
    """What the automata add to the base spans of a text; `spans` are its proposals. Of a token and
    a part of it the token stays."""
    whole = [Hit(a, 3, b, text[a:b]) for a, b in _free(spans, base) if judged.likely(text[a:b])]
    parts = [h for h in candidates(text, base) if judged.secret(h.value, least_gain)]
    return sorted([*whole, *(Hit(a, 3, b, text[a:b]) for a, b in _free([(h.start, h.end) for h in parts], whole))])


def labelled(found: DataFrame, samples: int = SAMPLES_PER_KIND, longest: int = LONGEST_SAMPLE) -> dict[str, list[str]]:
    """Distinct labelled values of each base kind that has any; the sample is bounded per kind."""
    values = found.select(F.explode("hits").alias("hit")).select("hit.*").filter(F.length("value") <= longest)
    samples_of = {}
    for rank, kind in enumerate(PATTERNS):
        own = values.filter(F.col("rank") == rank).select("value").distinct()
        rows = own.orderBy(F.xxhash64("value"), "value").limit(samples).collect()
        if rows:
            samples_of[kind] = sorted(r.value for r in rows)
    return samples_of


def best_gain(models: dict[str, Automaton], value: str) -> float:
    return max((m.gain(value) for m in models.values()), default=0.0)


HIT = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("value", pa.string())])


def propose(docs: DataFrame) -> DataFrame:
    """doc_id and hits: base spans and other candidates of every whole text."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_hits(text)
                hits.append([h._asdict() for h in (*base, *candidates(text, base))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(HIT))], ["doc_id", "hits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, hits array<struct<start: bigint, rank: int, end: bigint, value: string>>")


def _spelled(hits: list[Hit]) -> str:
    return ",".join(f"{KINDS[h.rank]}:{h.start}:{h.end}" for h in sorted(hits))


def scan(docs: DataFrame, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Counts, the hash of the base spans, all spans, and the highest gain of every document.

    Positions are code points, the end exclusive. A null or empty text has no spans; a null doc_id
    stays null; repeated rows are answered each time; no rows give no rows.
    """
    judged = judge(docs, materialise(propose(docs).filter("size(hits) > 0"), "secret-hits"))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), proposals(batch.column(1), judged)):
                text = text.as_py() or ""
                base = base_hits(text)
                added = formats(text, base, spans, judged, least_gain)
                gains = [best_gain(judged.models, h.value) for h in (*base, *candidates(text, base), *added)]
                counts = [sum(h.rank == k for h in base) for k in range(3)]
                rows.append((doc_id, *counts, hashlib.sha256(_spelled(base).encode()).hexdigest(), _spelled([*base, *added]), max(gains, default=None)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_gain"])

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, top_gain double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", least_gain: float = LEAST_GAIN) -> DataFrame:
    """The rows of docs with every secret replaced by `mark`; n_chars, if there, follows the text.

    The automata come from the docs themselves. A null text stays null, an empty one empty; repeated
    rows are changed alike; other columns are passed on, and no rows give no rows.
    """
    judged = judge(docs, materialise(propose(docs).filter("size(hits) > 0"), "secret-hits"))
    names, schema = docs.columns, docs.schema

    def cleaned(text: str, spans: list[tuple[int, int]]) -> str:
        base = base_hits(text)
        hits = sorted([*base, *formats(text, base, spans, judged, least_gain)])
        out, at = [], 0
        for h in hits:
            start = h.end - len(h.value) if h.rank == 0 else h.start
            if h.end > at:
                out += [text[at : max(at, start)], mark if start >= at else ""]
                at = h.end
        return "".join([*out, text[at:]])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            place = names.index("text")
            old = columns[place].to_pylist()
            new = [t if t is None else cleaned(t, spans) for t, spans in zip(old, proposals(columns[place], judged))]
            columns[place] = pa.array(new, columns[place].type)
            if "n_chars" in names:
                size = names.index("n_chars")
                sizes = [n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new)]
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)
