"""Spelling variants: words one edit apart, by pivotal grams.

The bigrams of a word, with their positions, are ordered by how many words hold them, rare first.
The prefix of a word is its first three and all others that are as rare as the third. One edit
changes at most one of two bigrams that share no letter, and any three bigrams hold two such: the
pivots, chosen by dynamic programming as the disjoint pair of the prefix that the fewest words hold.
Of two words that are one edit apart, take the one whose prefix ends at the rarer bigram: one of its
pivots is untouched, and it lies in the prefix of the other word. So pivots need to meet prefixes
only. The edit also fixes where: at the same place in a word of the same length, at the same place
or one further in a word that is one longer or shorter. Pivots and prefixes meet in an equi-join on
gram, position and length; a bit mask of letters thins the pairs, and all that are left are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.joins import join_unique
from pagequarry.session import materialise

# What a run of letters is, the rule that deletes a letter of a run, the least length
# and count of a word, and how many times as frequent its form is.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
DELETED_OF, LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 199, 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bigrams of a prefix, before those as rare as the last: twice the edits, and one.
PREFIX = 3


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of the texts: runs of letters, A to Z in lower case.

    A run whose checksum with its doc_id divides by DELETED_OF loses the letter that the checksum
    names, which plants misspellings. Null texts have no runs; a null doc_id is written as nothing.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LENGTH)  # others only get shorter
    checked = runs.select("run", F.crc32(F.concat("doc_id", F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DELETED_OF == 0, shorter).otherwise(F.col("run"))
    words = checked.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _grams(words: DataFrame) -> DataFrame:
    """(gram, held): in how many places of words each bigram lies."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    return words.filter(F.length("word") > 1).select(F.explode(F.transform(at, lambda k: F.substr("word", k, F.lit(2)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("held"))


def prefix_and_pivots(weights: np.ndarray) -> tuple[list[int], list[int]]:
    """Places of the prefix and of the pivots of a word, from the rank weights of its bigrams.

    Pivots are two places of the prefix that share no letter, with the least sum of weights: the
    cheapest one that ends before each place, carried from left to right.
    """
    last = np.sort(weights, kind="stable")[min(PREFIX, len(weights)) - 1]
    places = np.flatnonzero(weights <= last).tolist()
    cost = weights.tolist()
    best, pair, cheapest, waiting = None, [], None, []
    for place in places:
        # Places that end before this one may be its partner.
        while waiting and waiting[0] <= place - 2:
            one = waiting.pop(0)
            if cheapest is None or cost[one] < cost[cheapest]:
                cheapest = one
        if cheapest is not None and (best is None or cost[cheapest] + cost[place] < best):
            best, pair = cost[cheapest] + cost[place], [cheapest, place]
        waiting.append(place)
    return places, pair


_KEYS = "word string, letters bigint, gram string, place int, length int, last bigint, is_pivot boolean"


def _letters(word: Column) -> Column:
    """A bit per class of letters: whether a word has an odd number of them. An edit of one letter
    changes two bits at most."""
    at = F.sequence(F.lit(1), F.length(word))
    classes = F.transform(at, lambda k: F.pmod(F.xxhash64(F.substr(word, k, F.lit(1))), F.lit(63)).cast("int"))
    return F.aggregate(classes, F.lit(0).cast("bigint"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c)))


def _keys(words: DataFrame, grams: DataFrame) -> DataFrame:
    """One row per place of the prefix of a word; pivots are marked. `last` is the weight at which
    the prefix ends."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    listed = words.select("word", F.posexplode(F.transform(at, lambda k: F.substr("word", k, F.lit(2)))).alias("place", "gram"))
    # Equal counts are told apart by a hash of the gram, so that few grams tie.
    weight = F.shiftleft(F.col("held"), 20) + F.pmod(F.xxhash64("gram"), F.lit(1 << 20))
    weighed = join_unique(listed, materialise(grams.select("gram", weight.alias("weight")), "gram-weights"), "gram")
    whole = weighed.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("place", "gram", "weight"))).alias("grams"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for word, letters, held in zip(*(c.to_pylist() for c in batch.columns)):
                weights = np.array([g["weight"] for g in held])
                places, pivots = prefix_and_pivots(weights)
                last = int(weights[places].max())
                out += [(word, letters, held[p]["gram"], p, len(word), last, p in pivots) for p in places]
            columns = list(zip(*out)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [part.split()[0] for part in _KEYS.split(", ")])

    return whole.select("word", _letters(F.col("word")).alias("letters"), "grams").mapInArrow(run, _KEYS)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words that are one edit apart: exactly one
    code point inserted, deleted or replaced.

    `words` has word, each once and of at least four code points, and n.
    """
    keys = materialise(_keys(words, _grams(words)), "gram-keys")
    # Where the gram of a pivot may lie in a word of the same length, or one longer or shorter.
    place, length = F.col("place"), F.col("length")
    spots = [(place, length), (place, length + 1), (place + 1, length + 1), (place, length - 1), (place - 1, length - 1)]
    pivots = keys.filter("is_pivot").withColumn("spot", F.explode(F.array(*[F.struct(p.alias("place"), n.alias("length")) for p, n in spots])))
    side = lambda rows, n, *at: rows.select(F.xxhash64("gram", *at).alias("key"), *[F.col(c).alias(f"{c}_{n}") for c in ("word", "letters", "last")])
    # The words travel with their keys, and pairs are verified where they meet.
    met = side(pivots, "a", "spot.place", "spot.length").join(side(keys, "b", "place", "length"), "key")
    met = met.filter((F.col("last_a") <= F.col("last_b")) & (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2))
    found = met.filter(F.levenshtein("word_a", "word_b", 1) == 1).select("word_a", "word_b").distinct()
    # Two words whose prefixes end at one weight are found from both sides.
    both = materialise(found.unionByName(found.select(F.col("word_b").alias("word_a"), F.col("word_a").alias("word_b"))).distinct(), "near-words")
    counts = lambda name, n: words.select(F.col("word").alias(name), F.col("n").alias(n))
    return both.toDF("word", "near").join(counts("word", "n"), "word").join(counts("near", "near_n"), "near").select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: forms are followed by doubling the steps, each round
    written. A form is more frequent than its word, so there are no circles."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = join_unique(now, ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialise(moved, "roots")
        now = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    `words` has word, each once and of at least four code points, and n. The form is the near word
    of the largest n, ties to the smaller in code-point order, where it is at least FORM_TIMES as
    frequent; else null. The root is where forms lead, the word itself without a form. No words
    give no rows.
    """
    words = materialise(words, "vocabulary")
    near = near_pairs(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    named = words.join(best, "word", "left")
    often = -F.col("best.less") >= FORM_TIMES * F.col("n")
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    named = materialise(named, "forms")
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame) -> DataFrame:
    """The variants among the frequent words of all texts (`counted_words`)."""
    return variants(counted_words(docs))


VARIANTS_SQL = f"""
with recursive runs as (
  select doc_id, translate(run, '{_UPPER}', '{_LOWER}') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all
), checked as (
  select run, times, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [('0x' || x)::bigint for x in regexp_extract_all(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '..')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) as h from runs
), words as (
  select case when h % {DELETED_OF} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(times)::bigint as n
  from checked group by 1 having length(word) >= {LEAST_LENGTH} and n >= {LEAST_COUNT}
), places as (
  select word, n, unnest(range(1, length(word) + 1)) as spot from words
), cut as (
  select word, n, spot, substr(word, 1, spot - 1) as head, substr(word, spot + 1) as tail from places
), pairs as (
  select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.head = b.head and a.tail = b.tail and a.spot = b.spot and a.word <> b.word
  union
  select c.word, c.n, w.word, w.n from cut c join words w on w.word = c.head || c.tail
  union
  select w.word, w.n, c.word, c.n from cut c join words w on w.word = c.head || c.tail
), ranked as (
  select word, n, near, near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as place from pairs
), forms as (
  select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.near_n >= {FORM_TIMES} * w.n then r.near end as form, case when r.near_n >= {FORM_TIMES} * w.n then r.near_n end as form_n
  from words w left join ranked r on r.word = w.word and r.place = 1
), followed as (
  select word, form, 0 as steps, word as root from forms
  union all
  select f.word, n.form, f.steps + 1, n.word from followed f join forms n on n.word = f.form
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join (select word, arg_max(root, steps) as root from followed group by word) r using (word)
"""
