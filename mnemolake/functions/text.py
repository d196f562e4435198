"""Text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's \s has it.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

#: Texts that are noise, by group; the last group always counts.
DENIALS = (
    "(?i)i don'?t have (any )?(information|data|memory|record)",
    "(?i)i'?m not sure about",
    "(?i)i don'?t recall",
    "(?i)i don'?t remember",
    "(?i)it looks like i don'?t",
    "(?i)i wasn'?t able to find",
    "(?i)no (relevant )?memories found",
    "(?i)i don'?t have access to",
)
QUESTIONS = ("do you (remember|recall|know about)", "can you (remember|recall)", "did i (tell|mention|say|share)", "have i (told|mentioned|said)", "what did i (tell|say|mention)")
BOILERPLATE = ("(?i)^(hi|hello|hey|good morning|good evening|greetings)", "(?i)^fresh session", "(?i)^new session", "(?i)^HEARTBEAT")
HEADERS = (r"(?i)^Conversation info \(untrusted metadata\)", r"(?m)^---\s*\n\s*\{[\s\S]*?\}\s*\n\s*---", r"(?m)^\[?\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\]]*\]?\s*$")
#: Queries that are too slight to search for.
SKIPS = (
    r"(?i)^(hi|hello|hey|ok|好的|收到|嗯|谢谢|thanks|thx|got it|sure|yes|no|yep|nope|bye|再见)[\s!.。！]*$",
    r"(?i)^(fresh session|new session|/new|/compact|/restart|HEARTBEAT)",
    r"(?i)^/[a-z]+(\s|$)",
)
EMOJI_ONLY = (
    r"^[#*0-9\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}"
    r"\x{1F004}-\x{1F1FF}\x{1F201}-\x{1F251}\x{1F300}-\x{1FAF8}\s.,!?。！？，、]+$"
)
ASSET_MARK = r"(?i)\[(Pinned Asset|Memory Brief)\]"
#: What is stripped from an asset's text, in order.
ASSET_LABELS = (r"(?i)^\[(Pinned Asset|Memory Brief)\]\s*", r"(?i)\bSummary:\s*", r"(?i)\bSnippet:\s*", r"(?im)\bOriginal Scope:.*$", r"(?im)\bTags:.*$", r"(?i)\bSources:\s*", r"(?i)\bReusable:\s*", r"(?i)\bTakeaways:\s*", r"(?i)\bProfile:\s*", r"(?i)\bQuery:\s*")
MIN_QUERY = 4


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def clean_snippet(c: Column, n: int = 180) -> Column:
    return clip(collapse(c), n)


def title_of(c: Column) -> Column:
    found = F.substring(collapse(c), 1, 72)
    return F.when(found != "", found).otherwise("Pinned Memory")


def _terms(c: Column, least: int, most: int) -> Column:
    found = F.regexp_extract_all(c, F.lit(rf"(?i)(\p{{IsHan}}{{2,}}|[a-z0-9._/-]{{{least},}})"), 1)
    return F.slice(F.array_distinct(F.transform(found, F.lower)), 1, most)


def terms(c: Column) -> Column:
    return _terms(c, 3, 8)


def tags(c: Column) -> Column:
    return _terms(c, 4, 6)


def matched_terms(found: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.filter(found, lambda t: F.contains(low, t))


def sentences(c: Column) -> Column:
    marked = F.regexp_replace(c, r"([。！？.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+"), trim), lambda s: s != "")


def best_sentence(c: Column, query_terms: list[str]) -> Column:
    """The first of the sentences with the most different query terms, as (h: minus their number, i: place, s); null without sentences."""
    hits = lambda s: reduce(lambda a, t: a + F.contains(F.lower(s), F.lit(t)).cast("int"), query_terms, F.lit(0))
    return F.array_min(F.transform(sentences(c), lambda s, i: F.struct((-hits(s)).alias("h"), i.alias("i"), s.alias("s"))))


def best_snippet(c: Column, query_terms: list[str], n: int = 180) -> Column:
    """The best sentence as a snippet; the text itself without sentences."""
    return clean_snippet(F.coalesce(best_sentence(c, query_terms)["s"], c), n)


def is_noise(text: Column, denials: bool = True, questions: bool = True, boilerplate: bool = True) -> Column:
    t = trim(text)
    patterns = [*(DENIALS if denials else ()), *([rf"(?i)(?<![A-Za-z0-9_]){q}(?![A-Za-z0-9_])" for q in QUESTIONS] if questions else ()), *(BOILERPLATE if boilerplate else ()), *HEADERS]
    return reduce(lambda a, p: a | t.rlike(p), patterns, F.length(t) < 5)


def skips(query: Column) -> Column:
    t = trim(query)
    return reduce(lambda a, p: a | t.rlike(p), [*SKIPS, EMOJI_ONLY], utf16_length(t) < MIN_QUERY)


def should_skip(query: str) -> bool:
    t = query.strip("\ufeff").strip()
    if len(t.encode("utf-16-be")) // 2 < MIN_QUERY:
        return True
    emoji = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), EMOJI_ONLY)
    return any(re.search(p, t) for p in (*SKIPS, emoji))


def recall_text(text: Column, source: Column) -> Column:
    out = reduce(lambda c, p: F.regexp_replace(c, p, ""), ASSET_LABELS, text)
    return F.when(source == "asset", trim(F.regexp_replace(out, r"\n{2,}", "\n"))).otherwise(text)


def date_label(ts: Column) -> Column:
    return F.when(ts > 0, F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd")).otherwise("unknown")


def metadata_field(metadata: Column, name: str) -> Column:
    found = F.get_json_object(metadata, f"$.{name}")
    return F.when(found != "", found)


def source_label(metadata: Column, scope: Column) -> Column:
    return F.coalesce(metadata_field(metadata, "source"), F.when(scope != "", scope), F.lit("?"))


def file_label(metadata: Column) -> Column:
    return F.coalesce(metadata_field(metadata, "file"), metadata_field(metadata, "heading"), F.lit("-"))


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\p{IsHan}]+", "-"), "^-+|-+$", ""), 1, 48)


def cache_key(task: str, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{task}:"), text), 256), 1, 24)
