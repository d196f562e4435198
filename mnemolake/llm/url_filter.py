"""URL filters: a weighted vocabulary counted by an Aho-Corasick automaton, under rules for hosts and paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: One of these rejects a url.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirl", "camgirls", "escort", "escorts", "casino", "sexcam", "warez", "keygen", "viagra", "cialis")
#: Several different ones of these reject a url.
SOFT = ("adult", "bet", "betting", "bonus", "cheap", "click", "coupon", "crack", "dating", "free", "gambling", "jackpot", "loan", "loans", "lottery", "nude", "pills", "poker", "promo", "sexy", "slots", "torrent", "win")
SOFT_HITS = 2
#: verdict, host, start of the path
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty where it is null or has no `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


class Vocabulary:
    """Counts whole terms: what stands before and after one is neither an ASCII letter nor a digit."""

    def __init__(self, strict: tuple = STRICT, soft: tuple = SOFT, soft_hits: int = SOFT_HITS):
        import ahocorasick

        self.soft_hits = soft_hits
        self.automaton = ahocorasick.Automaton()
        for kind, terms in ((0, soft), (1, strict)):
            for t in terms:
                self.automaton.add_word(t.lower(), (kind, t.lower()))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int]:
        """Occurrences of strict terms, and different soft terms."""
        if not url or not len(self.automaton):
            return 0, 0
        low, strict, soft = url.lower(), 0, set()
        edge = lambda i: not (0 <= i < len(low)) or not (low[i].isascii() and low[i].isalnum())
        for end, (kind, term) in self.automaton.iter(low):
            if edge(end - len(term)) and edge(end + 1):
                if kind:
                    strict += 1
                else:
                    soft.add(term)
        return strict, len(soft)

    def rejects(self, url: str | None) -> bool:
        strict, soft = self.hits(url)
        return strict > 0 or soft >= self.soft_hits


def filter_urls(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits of every page, by its url alone.

    The longest rule that fits decides; without one, the vocabulary does. A null url has an empty host and
    path and is allowed. Rows may repeat; other columns are not read. Nothing is shuffled or cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Vocabulary(strict, soft, soft_hits).hits
        for batch in batches:
            found = [hits(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["page_id", "url", "strict_hits", "soft_hits"])

    counted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, url string, strict_hits long, soft_hits long")
    host, path = split_url(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits), "block").otherwise("allow")
    parted = counted.select("page_id", host.alias("host"), path.alias("path"), "strict_hits", "soft_hits")
    return parted.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in longest)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = "split(regexp_replace(u, '[^a-z0-9]+', ' ', 'g'), ' ')"
    listed = lambda terms: "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return f"""
WITH a AS (SELECT page_id, lower(coalesce(url, '')) AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, u, {low.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host, regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, len(list_filter({split}, lambda x: list_contains({listed(STRICT)}, x))) AS strict_hits,
 len(list_distinct(list_filter({split}, lambda x: list_contains({listed(SOFT)}, x)))) AS soft_hits FROM b)
SELECT page_id, host, path, {cases(lambda v, h, p: h + p)} END AS rule,
 {cases(lambda v, h, p: v)} WHEN strict_hits > 0 OR soft_hits >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
 CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_hits AS BIGINT) AS soft_hits FROM c
"""


QUERIES = {"op8_url_filter": op8_url_filter}
SQL = {"op8_url_filter": _sql()}
