"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

SQL expressions only. A text is split by a pattern and the matches are taken by the same pattern;
the lengths of both give every position, so the text is read twice per kind that occurs in it.
Capitals and digits after an account number look like more of it: its pattern takes only the first
four characters and looks ahead, and the checksum finds the end among the ends of groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
# Each pattern takes what its plain form takes, leftmost and without overlap, in linear time: a
# match can begin only where a run of its first characters does.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only chains of 12 to 19 digits: others fail as a whole.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Takes the head; group 1 is all that could belong to it, and the next letter or digit.
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z0-9]{4}",
}
IBAN_HEAD, IBAN_LENGTHS = 4, (15, 34)
# Lengths of the registry. Other countries may have any.
COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
BASE_KINDS = ("email", "ip", "card", "phone")
# A cheap test that a text can hold the kind at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|expir",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer",
}
# Score of the form alone, of a passed checksum, and of a context word within reach.
FORM_SCORE, CHECK_SCORE, CONTEXT_SCORE = 0.5, 0.3, 0.2
CHECKED = ("card", "iban")
REACH = 40
RUN = 256


def luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        digit = F.ascii(F.substring(digits, -k, F.lit(1))) - 48
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(k % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def add(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substring(moved, k, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(F.translate(match, " -", ""))
    if kind == "phone":
        return F.length(F.translate(match, " ().-+", "")).between(9, 15)
    return F.lit(True)


def account(seen: Column) -> Column:
    """The account number at the start of what the pattern saw, or null.

    It ends where a group does and passes mod-97. The length that the registry gives the country
    goes first; then the longest run of groups, and any shorter one where the country is not listed.
    """
    lengths = {c: n for n, names in COUNTRIES.items() for c in names.split()}
    listed = F.create_map(*(F.lit(x) for pair in lengths.items() for x in pair))
    length = F.try_element_at(listed, F.substring(seen, 1, 2))
    groups = F.split(seen, " ")

    def upto(k: Column) -> Column:
        own = F.slice(groups, F.lit(1), k)
        plain = F.array_join(own, "")
        return F.struct(F.coalesce(F.length(plain) == length, F.lit(False)).alias("listed"), F.length(plain).alias("size"), plain.alias("plain"), F.array_join(own, " ").alias("text"))

    ends = F.transform(F.sequence(F.lit(1), F.size(groups)), upto)
    whole = F.filter(ends, lambda e: e["size"].between(*IBAN_LENGTHS) & ~F.rlike(e["plain"], F.lit("[a-z]")))
    longest = F.array_max(F.transform(whole, lambda e: e["size"]))
    right = F.filter(whole, lambda e: (length.isNull() | e["listed"] | (e["size"] == longest)) & mod97(e["plain"]))
    return F.array_max(right)["text"]


def apart(spans: Column) -> Column:
    """Spans, in order of start, without those that begin before an earlier one ends."""
    none = F.filter(spans, lambda s: F.lit(False))
    add = lambda got, s: F.when(F.coalesce(F.get(got, F.size(got) - 1)["end"], F.lit(0)) <= s["start"], F.concat(got, F.array(s))).otherwise(got)
    meets = F.exists(F.transform(spans, lambda s, n: (n > 0) & (F.get(spans, n - 1)["end"] > s["start"])), lambda m: m)
    return F.when(meets, F.aggregate(spans, none, add)).otherwise(spans)


def _totals(values: Column, before: Column) -> Column:
    """before, before + values[0], before + values[0] + values[1], ..."""
    add = lambda got, v: F.concat(got, F.array(F.element_at(got, -1) + v))
    return F.aggregate(values, F.array(before), add)


def _run(values: str, k: Column) -> Column:
    return F.slice(F.col(values), k * RUN + 1, RUN)


def find_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and an array `pii` of (start, rank, end, kind, score, text) in order.

    Positions are code points, the end exclusive. A null or empty text has no spans.
    """
    names = [f"_keep{n}" for n in range(len(keep))]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), text.alias("_text"))
    has = {k: (F.contains("_text", F.lit(NEEDS[k])) & F.rlike("_text", F.lit(p)) if k in NEEDS else F.rlike("_text", F.lit(p))) for k, p in PATTERNS.items()}
    rows = rows.select(*names, "_text", *(c.alias(f"_has_{k}") for k, c in has.items()))
    cut = []
    for k, p in PATTERNS.items():
        held = F.when(F.col(f"_has_{k}"), F.col("_text"))
        cut += [F.split(held, p, -1).alias(f"_gaps_{k}"), F.regexp_extract_all(held, F.lit(p), F.lit(int(k == "iban"))).alias(f"_found_{k}")]
    rows = rows.select(*names, *cut)

    def step(make) -> DataFrame:
        return rows.select("*", *(F.when(F.col(f"_found_{k}").isNotNull(), make(k)).alias(name) for k in PATTERNS for name in [f"_{make.__name__}_{k}"]))

    # Running totals in runs of RUN matches, so that a text with very many stays cheap.
    def lengths(k: str) -> Column:
        taken = lambda m: F.when(m.isNotNull(), IBAN_HEAD) if k == "iban" else F.length(m)
        return F.transform(F.col(f"_gaps_{k}"), lambda g, n: (F.length(g) + F.coalesce(taken(F.get(F.col(f"_found_{k}"), n - 1)), F.lit(0))).cast("bigint"))

    rows = step(lengths)

    def sums(k: str) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(f"_lengths_{k}") - 1) / RUN).cast("int"))
        return F.transform(runs, lambda r: F.aggregate(_run(f"_lengths_{k}", r), F.lit(0).cast("bigint"), lambda a, v: a + v))

    rows = step(sums)

    def before(k: str) -> Column:
        return _totals(F.col(f"_sums_{k}"), F.lit(0).cast("bigint"))

    rows = step(before)

    def starts(k: str) -> Column:
        inside = lambda total, r: F.slice(_totals(_run(f"_lengths_{k}", r), F.get(F.col(f"_before_{k}"), r)), 2, RUN)
        return F.flatten(F.transform(F.col(f"_sums_{k}"), inside))

    rows = step(starts)

    # Accounts by head, so that the checksum is taken once.
    rows = rows.withColumn("_ends_iban", F.transform("_found_iban", account))

    def spans(k: str) -> Column:
        gap = lambda n: F.get(F.col(f"_gaps_{k}"), n)

        def head(n: Column) -> Column:
            return F.coalesce(F.substring(F.get(F.col("_found_iban"), n), 1, IBAN_HEAD), F.lit(""))

        def one(match: Column, n: Column) -> Column:
            start = F.get(F.col(f"_starts_{k}"), n)
            left = F.substring(gap(n), -REACH, REACH)
            right = F.substring(gap(n + 1), 1, REACH)
            if k == "iban":
                # The rest of the account, and other heads, lie in the gaps.
                match = F.get(F.col("_ends_iban"), n)
                left = F.substring(F.concat(F.coalesce(F.substring(F.when(n > 0, gap(n - 1)), -REACH, REACH), F.lit("")), head(n - 1), left), -REACH, REACH)
                after = F.concat(F.substring(gap(n + 1), 1, 3 * REACH), head(n + 1), F.coalesce(F.substring(gap(n + 2), 1, 3 * REACH), F.lit("")))
                right = F.substring(after, F.length(match) - IBAN_HEAD + 1, F.lit(REACH))
            near = F.rlike(F.lower(F.concat_ws(" ", left, right)), F.lit(CONTEXT[k]))
            score = F.lit(FORM_SCORE + CHECK_SCORE * (k in CHECKED)) + F.when(near, CONTEXT_SCORE).otherwise(0.0)
            return F.struct(
                start.alias("start"),
                F.lit(list(PATTERNS).index(k)).alias("rank"),
                (start + F.length(match)).alias("end"),
                F.lit(k).alias("kind"),
                F.round(score, 2).alias("score"),
                match.alias("text"),
            )

        made = F.transform(F.col(f"_found_{k}"), one)
        return apart(F.filter(made, lambda s: s["text"].isNotNull())) if k == "iban" else F.filter(made, lambda s: confirmed(k, s["text"]))

    rows = step(spans)
    every = [F.col(f"_spans_{k}") for k in PATTERNS]
    none = F.filter(F.array(every[0][0]), lambda s: F.lit(False))
    joined = F.when(reduce(lambda a, b: a | b, (e.isNotNull() for e in every)), F.array_sort(F.flatten(F.array(*(F.coalesce(e, none) for e in every)))))
    return rows.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), F.coalesce(joined, none).alias("pii"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans of every document, as text.

    No rows give no rows; a null doc_id stays null; repeated rows are answered each time.
    """
    found = find_spans(docs, "doc_id")
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(list(kinds)))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in (*BASE_KINDS, "iban")),
        F.sha2(_listed(of(*BASE_KINDS)), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )
