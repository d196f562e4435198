"""Scores of relevance cases against results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

CASE = "name string, expect_any array<string>, expect_all array<string>, expect_scopes array<string>, forbid array<string>"


def case_reports(cases: DataFrame, results: DataFrame) -> DataFrame:
    """The cases with score, passed, hits and what of each list was met, top_scopes (five) and top_snippet; results are (name, position, scope, text, metadata), a few for each case."""
    line = F.lower(F.concat_ws("\n", "scope", "text", "metadata"))
    in_order = F.array_sort(F.collect_list(F.struct("position", line.alias("l"), "scope", "text")))
    r = results.groupBy("name").agg(in_order.alias("r"), F.count(F.lit(1)).alias("hits"))
    r = r.select("name", "hits", F.array_join(F.transform("r", lambda s: s["l"]), "\n").alias("joined"), F.transform("r", lambda s: s["scope"]).alias("scopes"), X.clean_snippet(F.element_at("r", 1)["text"], 140).alias("top_snippet"))
    c = cases.join(r, "name", "left").withColumns({"joined": F.coalesce("joined", F.lit("")), "hits": F.coalesce("hits", F.lit(0)), "scopes": F.coalesce("scopes", F.array().cast("array<string>")), "top_snippet": F.coalesce("top_snippet", F.lit("-"))})
    met = lambda col: F.filter(col, lambda t: F.contains(F.col("joined"), F.lower(t)))
    c = c.withColumns({"matched_any": met("expect_any"), "matched_all": met("expect_all"), "matched_scopes": F.filter("expect_scopes", lambda p: F.exists("scopes", lambda s: s.startswith(p))), "forbidden": met("forbid")})
    share = lambda got, col, w: F.when(F.size(col) > 0, F.size(got) / F.size(col) * w).otherwise(w)
    bad = F.size("forbidden") > 0
    score = share("matched_any", "expect_any", 0.4) + share("matched_all", "expect_all", 0.3) + share("matched_scopes", "expect_scopes", 0.2) + F.when(F.col("hits") > 0, 0.1).otherwise(0.0) - F.when(bad, 0.3).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    told = {"score": F.round(score, 6), "passed": (F.round(score, 9) >= 0.7) & ~bad, "hits": F.col("hits").cast("long"), "top_scopes": F.slice("scopes", 1, 5)}
    return c.withColumns(told).drop("joined", "scopes")


def score_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """name, score, passed, hits; results are (name, position, scope, text, metadata), a few for each case."""
    return case_reports(cases, results).select("name", "score", "passed", "hits")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """CASE columns, with query, profile, scope, limit and notes, of a JSON array of cases; lists that are missing are empty."""
    source = "name string, query string, profile string, scope string, `limit` int, expectAny array<string>, expectAll array<string>, expectScopePrefixes array<string>, forbid array<string>, notes string"
    j = spark.read.schema(source).option("multiLine", True).json(path)
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return j.select("name", "query", F.coalesce("profile", F.lit("default")).alias("profile"), "scope", F.coalesce("limit", F.lit(5)).alias("limit"), some("expectAny").alias("expect_any"), some("expectAll").alias("expect_all"), some("expectScopePrefixes").alias("expect_scopes"), some("forbid").alias("forbid"), "notes")


def totals(scores: DataFrame) -> DataFrame:
    """cases, passed, average score."""
    return scores.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("average"))


def report(scores: DataFrame, generated: str) -> list[str]:
    """The lines of a report: totals, and a table row for each case; cases are few."""
    t = totals(scores).first()
    rows = scores.orderBy("name").collect()
    head = ["# Evaluation", "", f"- Generated: {generated}", f"- Cases: {t.cases}", f"- Passed: {t.passed}/{t.cases}", f"- Average score: {t.average * 100:.1f}%", "", "| Case | Score | Pass | Hits |", "|-|-|-|-|"]
    return head + [f"| {r.name} | {r.score * 100:.0f}% | {'yes' if r.passed else 'no'} | {r.hits} |" for r in rows]


def report_text(reports: DataFrame, generated: str, kind: str = "md") -> str:
    """A report of case_reports() as text: `md` with the lines of report() and notes on each case, or `json`. Cases are few."""
    rows = [r.asDict(recursive=True) for r in reports.orderBy("name").collect()]
    if kind == "json":
        return json.dumps({"generated": generated, "reports": rows}, indent=2, ensure_ascii=False) + "\n"
    if kind != "md":
        raise ValueError(f"unknown kind of report: {kind}")
    shown = lambda v: ", ".join(v) if v else "-"
    named = [("Query", "query"), ("Profile", "profile"), ("Top scopes", "top_scopes"), ("Top snippet", "top_snippet"), ("Matched any", "matched_any"), ("Matched all", "matched_all"), ("Matched scopes", "matched_scopes"), ("Forbidden matches", "forbidden"), ("Notes", "notes")]
    notes = [line for r in rows for line in (f"### {r['name']}", *(f"- {label}: {shown(r[c]) if isinstance(r[c], list) else r[c]}" for label, c in named if c in r and r[c] is not None), "")]
    return "\n".join([*report(reports, generated), "", "## Cases", "", *notes]) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small text as a file, wherever Spark's files are."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
