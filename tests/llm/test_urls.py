import random
import re

import pytest

from compare import compare, sql_engine
from pagequarry.llm import urls
from pagequarry.llm.oracles import ORACLES
from pagequarry.llm.queries import QUERIES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute(rules, url, default):
    """Every rule against the url, one after another."""
    host, path = split(url)
    best = None
    for rule, verdict in rules:
        if rule is None or verdict not in ("allow", "block"):
            continue
        own, slash, rest = rule.partition("/")
        own = own.lower()
        if (own == "" or host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            rank = (len(own.split(".")) if own else 0, len(slash + rest))
            if best is None or rank > best[0] or rank == best[0] and (verdict, rule) > best[1]:
                best = (rank, (verdict, rule))
    return host, path, best and best[1][1], best[1][0] if best else default


TRICKY = [
    None, "", "no scheme", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://example.com/en", "http://example.com/en/",
    "http://example.com./en/", "http://notexample.com/en/", "http://a.b.example.com/en//x", "https://x.net?u=http://example.com/en/", "ftp://example.net/es/",
    "http://user@example.com:80/en/", "http://com/en/", "http://net/fr", "http://net/fr/" + "x/" * 100_000, "a://b://example.com/en/", "http://ÉXAMPLE.com/en/", "http://example.com\n/en/",
]


def test_registered_query(spark, folder):
    got = compare(spark, sql_engine(folder), "op11", QUERIES["op11_urls"], ORACLES["op11_urls"], folder)
    assert got["ok"], got["why"]


def test_tricky_urls_clashing_names_and_no_rows(spark):
    rows = [(n, u, "h", 1, 2.0) for n, u in enumerate(TRICKY)] + [(None, TRICKY[5], None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, labels int, `rule.x` double").repartition(3)
    got = urls.judge(pages, spark.createDataFrame(urls.PAGE_RULES, urls.RULES))
    assert got.columns == ["page_id", "url", "labels", "rule.x", "host", "path", "rule", "verdict"]
    found = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str)
    assert found == sorted(((n, *brute(urls.PAGE_RULES, u, "allow")) for n, u, *_ in rows), key=str)
    assert urls.judge_pages(pages.limit(0)).count() == 0
    bare = urls.judge(pages, spark.createDataFrame([], urls.RULES), default="block")
    assert {(r.rule, r.verdict) for r in bare.collect()} == {(None, "block")}


@pytest.mark.parametrize("seed,bytes_a_round", [(0, 1 << 22), (1, 700), (2, 64)])
def test_random_rules_and_rounds(spark, seed, bytes_a_round):
    """Rules that overlap in every way, in one round and in many."""
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "net", ""]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/x", "/xy", "/X/", "y"]) for _ in range(rng.randint(0, 4)))
    rules = [(f"{host()}{'/' if rng.random() < 0.7 else ''}{path().lstrip('/')}", rng.choice(["allow", "block"])) for _ in range(60)]
    rules = [(r if "/" in r else r.rstrip("xyX"), v) for r, v in rules] + [(None, "allow"), ("a/", "maybe"), rules[0]]
    pages = [(n, f"http://{host()}{'/' + path().lstrip('/') if rng.random() < 0.9 else ''}") for n in range(400)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    got = urls.judge(frame, spark.createDataFrame(rules, urls.RULES), round_bytes=bytes_a_round)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert found == {n: brute(rules, u, "allow") for n, u in pages}


def test_case_of_hosts(spark):
    """Entries that differ in the case of their host are one entry; blocking holds in any round."""
    rules = spark.createDataFrame([("A.net/x", "block"), ("a.NET/x", "allow"), ("a.net/X", "allow")], urls.RULES)
    page = spark.createDataFrame([(1, "http://a.net/xy"), (2, "http://b.A.net/X")], "page_id bigint, url string")
    for size in (1 << 20, 8):
        assert sorted((r.page_id, r.rule, r.verdict) for r in urls.judge(page, rules, round_bytes=size).collect()) == [(1, "A.net/x", "block"), (2, "a.net/X", "allow")]
