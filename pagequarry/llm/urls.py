"""URL filters: a trie over reversed host labels and path segments, with longest match.

Rules are entries of a host and the beginning of a path that allow or block. The trie of a round of
rules is broadcast; rounds are cut by the bytes of the rules, run one after another and only one
broadcast is alive at a time, so a list of any length is judged without moving a page.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import materialise, scratch_path

RULES = "rule string, verdict string"
# Bytes of rule texts in one broadcast trie; the trie takes about 30 times as much in a task.
ROUND_BYTES = 4 << 20
# What a url that no rule fits gets.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.position(F.lit("://"), url) + 3))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z in lower case; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class Match(NamedTuple):
    """Labels of the rule's host, characters of its path, its text, and whether it allows."""

    labels: int
    path: int
    rule: str
    allows: bool


class RuleTrie:
    """Reversed host labels, under each of these path segments, under these beginnings of a segment.

    A node is [children by label, paths]; a path node is [children by segment, beginnings], where
    beginnings maps the last, open segment of a rule to the rule. The empty host fits every host,
    the empty path every path.
    """

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.root: list = [{}, None]
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            labels = host.translate(str.maketrans(_UPPER, _LOWER)).split(".")[::-1] if host else []
            node = self.root
            for label in labels:
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            place = node[1]
            *whole, rest = (slash + path).split("/")
            for segment in whole:
                place = place[0].setdefault(segment, [{}, {}])
            found = Match(len(labels), len(slash + path), rule, verdict == "allow")
            before = place[1].get(rest)
            # Of an allow and a block entry for one place the block entry holds.
            if before is None or (before.allows, before.rule) > (found.allows, found.rule):
                place[1][rest] = found

    def places(self, host: str) -> list[list]:
        """The path tries of all entries that fit the host, the longest host first."""
        found, node = [self.root[1]], self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            found.append(node[1])
        return [place for place in reversed(found) if place is not None]

    def match(self, places: list[list], path: str) -> Match | None:
        """The rule of the longest host that fits, and of these the one with the longest path."""
        segments = path.split("/")
        for place in places:
            best = None
            for segment in segments:
                open_ends = place[1]
                if open_ends:
                    fitting = [m for rest, m in open_ends.items() if segment.startswith(rest)] if len(open_ends) <= len(segment) else [open_ends[segment[:n]] for n in range(len(segment) + 1) if segment[:n] in open_ends]
                    best = max(fitting, key=lambda m: m.path, default=best)
                place = place[0].get(segment)
                if place is None:
                    break
            if best is not None:
                return best
        return None


def _rounds(rules: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The distinct rules with a round number each, and how many rounds there are."""
    kept = rules.select("rule", "verdict").filter("rule is not null and verdict in ('allow', 'block')").distinct()
    total = kept.agg(F.sum(F.octet_length("rule") + 16)).first()[0] or 0
    count = max(1, -(-total // most))
    # Entries that differ only in case are in one round.
    return kept.withColumn("round", F.pmod(F.xxhash64(F.lower("rule")), F.lit(count))), count


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", *, default: str = DEFAULT, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """All columns of urls, and host, path, rule and verdict of each row.

    `rules` has rule (host, then the beginning of a path) and verdict (allow or block). A rule fits
    its host and all subdomains where the path starts with the rule's. The rule of the most host
    labels holds, and of these the one with the longest path; an entry that is both allowed and
    blocked blocks. Hosts ignore the case of A to Z, paths do not. Where no rule fits, rule is null
    and the verdict is `default`. A null url and one without :// have an empty host and path. Rules
    that are null or have another verdict do not count; repeated rows are judged each; no rules
    leave every url to the default; no rows give no rows. Columns of urls that are called host,
    path, rule or verdict are replaced.
    """
    added = ["host", "path", "rule", "verdict"]
    spark: SparkSession = urls.sparkSession
    kept = urls.drop(*added)
    # Positions, not names: columns may hold dots or the names used here.
    frame = kept.toDF(*[f"c{n}" for n in range(len(kept.columns))])
    at = frame.columns[kept.columns.index(url)]
    blank = [F.lit(0).alias("labels"), F.lit(-1).alias("length"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("allows")]
    frame = frame.select("*", host_of(F.col(at)).alias("host"), path_of(F.col(at)).alias("path"), *blank)
    numbered, count = _rounds(rules, round_bytes)
    if count > 1:
        folder = scratch_path(spark, "url-rules")
        numbered.repartition("round").write.partitionBy("round").parquet(folder)
        numbered = spark.read.schema(numbered.schema).parquet(folder)
    for n in range(count):
        held = numbered.filter(F.col("round") == n).select("rule", "verdict").toArrow().to_pylist()
        shared = spark.sparkContext.broadcast([(r["rule"], r["verdict"]) for r in held])
        frame = frame.mapInArrow(_matcher(shared), frame.schema)
        if n + 1 < count:
            frame = materialise(frame, "judged")
            shared.unpersist()
    verdict = F.when(F.col("allows"), "allow").when(~F.col("allows"), "block").otherwise(default)
    return frame.select(*[F.col(f"c{n}").alias(name) for n, name in enumerate(kept.columns)], "host", "path", "rule", verdict.alias("verdict"))


def _matcher(shared):
    """Improves (labels, length, rule, allows) of every row by the rules of one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RuleTrie(shared.value)
        for batch in batches:
            names = batch.schema.names
            hosts = batch.column("host").dictionary_encode()
            places = [trie.places(host) for host in hosts.dictionary.to_pylist()]
            found = [trie.match(places[h], p) for h, p in zip(hosts.indices.to_numpy(), batch.column("path").to_pylist())]
            labels, length = batch.column("labels").to_numpy(), batch.column("length").to_numpy()
            better = np.array([m is not None and (m.labels, m.path) > (a, b) for m, a, b in zip(found, labels, length)], bool)
            new = {
                "labels": [m.labels if b else o for m, b, o in zip(found, better, labels.tolist())],
                "length": [m.path if b else o for m, b, o in zip(found, better, length.tolist())],
                "rule": [m.rule if b else o for m, b, o in zip(found, better, batch.column("rule").to_pylist())],
                "allows": [m.allows if b else o for m, b, o in zip(found, better, batch.column("allows").to_pylist())],
            }
            arrays = [pa.array(new[n], batch.schema.field(n).type) if n in new else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


# The rules of the registered query. Fixed values.
PAGE_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def judge_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page under PAGE_RULES."""
    rules = pages.sparkSession.createDataFrame(PAGE_RULES, RULES)
    return judge(pages.select("page_id", "url"), rules).drop("url")


JUDGE_SQL = """
with cut as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages
), parts as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut
), rules(host, path, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
    row_number() over (partition by p.page_id, p.host, p.path order by len(string_split(r.host, '.')) desc, length(r.path) desc) as place
  from (select distinct * from parts) p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fitting f on f.place = 1 and p.page_id is not distinct from f.page_id and p.host = f.host and p.path = f.path
"""
