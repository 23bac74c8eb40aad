import hashlib
import random
import re

from pagequarry.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    return True


def brute(text):
    found = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    found.sort()
    spell = lambda part: ",".join(f"{k}:{s}:{e}" for s, _, e, k in part)
    base = [f for f in found if f[3] != "iban"]
    return (*(sum(f[3] == k for f in base) for k in pii.BASE_KINDS), hashlib.sha256(spell(base).encode()).hexdigest(), spell(found))


def answers(frame):
    return sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in frame.collect()), key=str)


def expected(rows):
    return sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_against_plain_patterns(spark):
    rng = random.Random(1)
    parts = ["a@b.c", "x.y@m-1.example.com", "@", ".", "a", " ", "1.2.3.4", "300.1.1.1", "4539 5787 6362 1486", "4539578763621486", "7", "-", "+1 (017) 555-7713", "+", "(", "é", "\U0001f600", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "iban ", "0000001.2.3.004", "\n", "_d@e.f", "12", "a@b", "--"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += ["1" * 50_000, "a" * 50_000, "1 " * 40_000, "a@b.c " * 1500, "+1" * 20_000, "1.1." * 20_000, "a." * 20_000 + "@", None, ""]
    rows = list(enumerate(texts))
    assert answers(pii.digest(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)


def test_tricky_and_empty(tricky, nothing):
    assert answers(pii.digest(tricky)) == expected(tricky.select("doc_id", "text").collect())
    assert pii.digest(nothing).count() == 0


def test_whole_table(spark, folder):
    from pagequarry.llm.queries import QUERIES

    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert answers(QUERIES["op3_pii"](spark, folder)) == expected(rows)


def test_scores_and_text(spark):
    text = "call me at +44 20 7946 0958 soon. " + "x" * 50 + " 4539578763621486"
    found = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id").first().pii
    assert [(s.kind, s.text, s.score) for s in found] == [("phone", "+44 20 7946 0958", 0.7), ("card", "4539578763621486", 0.8)]


def test_no_python(spark, folder):
    from pagequarry.llm.queries import QUERIES

    plan = QUERIES["op3_pii"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_accounts_before_capitals_numbers_and_accounts(spark):
    plain, spaced, british = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    cases = [
        (f"{plain} Please pay", [plain]),
        (f"{spaced} Bitte", [spaced]),
        (f"{spaced} BIC COBADEFF", [spaced]),
        (f"{spaced} 2024-01-01", [spaced]),
        (f"{spaced} {british} {plain} {spaced}", [spaced, british, plain, spaced]),
        (f"\U0001f600 order AB12 {spaced} 12 {british} X", [spaced, british]),
        (f"{plain} {plain}x {plain}1 x{plain} {plain[:-1]}1", [plain]),
        ("MT84 MALT 0110 0001 2345 MTLC AST0 01S OK NO93 8601 1117 947 AND", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S", "NO93 8601 1117 947"]),
        (" ".join([spaced] * 700), [spaced] * 700),
    ]
    frame = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    got = {r.doc_id: r.pii for r in pii.find_spans(frame, "doc_id").collect()}
    for n, (text, want) in enumerate(cases):
        spans = [s for s in got[n] if s.kind == "iban"]
        assert [s.text for s in spans] == want
        assert [text[s.start : s.end] for s in spans] == want


def test_context_of_accounts(spark):
    texts = ["IBAN AB12 DE89 3704 0044 0532 0130 00 Bitte", "DE89 3704 0044 0532 0130 00 Bank", "so DE89 3704 0044 0532 0130 00 Bitte"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: [s.score for s in r.pii if s.kind == "iban"] for r in pii.find_spans(frame, "doc_id").collect()}
    assert got == {0: [1.0], 1: [1.0], 2: [0.8]}
