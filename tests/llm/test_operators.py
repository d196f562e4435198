import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm import common, decontamination, embedding_dedup, html_extract, license_scan, ngram_join, packing, quality, token_files, toxicity, url_filter
from mnemolake.llm.tokens import WordTokenizer

from ..conftest import SF, same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, class string, root string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties and clashing column names."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id here at all"), (None, None), (4, base), (5, base + " more"), (6, base), (7, "x " * 30000), (8, "a\n\n\tb  c "), (9, "Licensed under the Apache License, Version 2.0.\n" + base[:50])]
    return spark.createDataFrame([(d, t, None, "s", None, 1, "c", "r", "p") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_decontamination", "op6_embedding_dedup", "op8_url_filter"])
def test_rows_equal_sql(spark, name):
    same_rows(spark, name)


# 1
def test_license_model_and_edges(spark, odd, none):
    m = license_scan.model()
    assert m.held_out_accuracy > 0.95
    got = license_scan.scan_licenses(spark, odd).collect()
    assert len(got) == odd.count() and {r.licenses for r in got if r.doc_id == 9} == {"apache-2.0"} and all(r.licenses == "" for r in got if r.doc_id != 9)
    assert license_scan.scan_licenses(spark, none).count() == 0
    assert not any("Python" in x or "Arrow" in x for x in [license_scan.scan_licenses(spark, odd)._jdf.queryExecution().toString()])


def test_license_gate_loses_nothing():
    for _, own in license_scan.model().templates:
        assert sum(not re.search(license_scan.gate(), g) for g in own) < license_scan.CONFIRM * len(own)


@given(st.lists(st.sampled_from([*license_scan.ANCHORS, *license_scan.gate_words(), "domain", "xunder", "underx", "cc", "public", "é", "\n", " ", "-", "4", "9"]), max_size=6))
def test_license_quick_gate_equals_gate(parts):
    for text in ("".join(parts), " ".join(parts), "".join(parts)[1:-1]):
        assert bool(re.search(license_scan.quick(), text)) == bool(re.search(license_scan.gate(), text))


def test_license_lines_and_runs_of_many_marks(spark):
    """A run comes from its first marked line alone, and lines of its own that overlap it do not count."""
    notice = "\n".join(["Permission is hereby granted, free of charge,", "to any person obtaining a copy of this software", "and associated documentation files, to deal", "in the Software without restriction."])
    texts = [notice, notice + "\n" + notice, notice + "\n\n" + notice, "\n".join(["under"] * 60), notice.replace("\n", "\n\n"), None, "", "under\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, notice), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.licenses, r.n_licensed) for r in license_scan.scan_licenses(spark, frame).collect())
    assert [g for g in got if not g[0]] == [(False, 0, "mit", 1), (False, 1, "mit", 2), (False, 1, "mit", 2), (False, 2, "mit", 2), (False, 3, "", 0), (False, 4, "", 0), (False, 5, "", 0), (False, 6, "", 0), (False, 7, "", 0)]
    assert [g[2:] for g in got if g[0]] == [("", 0), ("mit", 1)]


def test_all_notices_are_found_when_wrapped(spark):
    import textwrap

    notes = [(f, n) for f, own in license_scan.TEMPLATES.items() for n in own if len(n) > 110]
    rows = [(i, "Some prose stands here before it.\n\n" + "\n".join(textwrap.wrap(n, 60)) + "\n\nAnd prose after it.") for i, (_, n) in enumerate(notes)]
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: f for i, (f, _) in enumerate(notes)} == got


def test_wrapped_licenses(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software.'
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    prose = "A line of plain prose before it\nand a second one\n"
    rows = [(1, gpl, "gpl-3.0"), (2, mit, "mit"), (3, bsd, "bsd"), (4, prose + "\n# " + gpl.replace("\n", "\n# ") + "\n\nThe end", "gpl-3.0"), (5, prose + "All rights\nreserved.", "proprietary"), (6, prose + "Released under the MIT License.", "mit"), (7, prose + "She lost her license\nand the warranty", "")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: f for i, _, f in rows}
    assert got[6].n_licensed == 1 and got[1].n_licensed == 1


# 2
def brute(texts):
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}


@pytest.mark.parametrize("block", [1024, 4])
def test_ngram_join_finds_all_links(spark, block):
    docs = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    words = [" ".join(f"w{i}" for i in range(80)).split() for _ in range(30)]
    for k, w in enumerate(words):  # a chain of near copies
        w[: k // 3] = [f"v{i}" for i in range(k // 3)]
    rows = [(r.doc_id, r.text) for r in docs] + [(10_000 + k, " ".join(w)) for k, w in enumerate(words)]
    links, n = brute([t for _, t in rows]), defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    up = ngram_join.roots(len(rows), np.array([a for a, _ in links]), np.array([b for _, b in links]))
    least = defaultdict(list)
    for i, r in enumerate(up):
        least[r].append(rows[i][0])
    got = {r.doc_id: r for r in ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    for i, (d, _) in enumerate(rows):
        assert got[d].n_links == n[i] and got[d].group_id == min(least[up[i]]) and got[d].kept == (d == min(least[up[i]])), d


def test_ngram_join_edges(spark, odd, none):
    got = ngram_join.near_duplicates(spark, odd).collect()
    assert len(got) == odd.count() and ngram_join.near_duplicates(spark, none).count() == 0
    of = {r.doc_id: r for r in got}
    assert (of[6].class_id, of[5].group_id, of[4].n_links, of[3].n_links, of[2].n_links) == (4, 4, 2, 1, 0)
    kept = sorted(r.doc_id for r in ngram_join.deduplicate(spark, odd).where("doc_id is not null").collect())
    assert kept == [1, 2, 3, 4, 7, 8, 9] and ngram_join.deduplicate(spark, odd).columns == odd.columns
    assert ngram_join.deduplicate(spark, odd).where("doc_id is null").count() == 2


def test_pruning_keeps_what_may_reach_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * ngram_join.HASHES


# 3 and the tokenizer
@lru_cache
def library(name):
    """ids of a text by a freshly loaded tokenizer of the library."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(fresh.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
AWKWARD = ["see <|endoftext|> here", "<|startoftext|>", "hello <|startoftext|> world", "a\n\nb", "a\n\n\nb", "a \nb", "a\n b", "a\t \n b", "a\t\n\nb", "\n", " ", "", "\na", "a\n", "\n\na", "don't stop, it's (so) good'", "x\u00a0y", "\u00a0y z", "z y\u00a0", "a\x85\n\nb", "1234 5.6,7", "MIXED case", "\u1112\u1161\u11ab", "e\u0301 \u0301", "\ud7a3"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB .,'\n\t\u00a0\u2003é́ß中1 Σİ<|>", max_size=40), max_size=5))
@pytest.mark.parametrize("name", VOCABULARIES)
def test_tokenizer_equals_library(name, texts):
    from mnemolake.llm.tokens import tokenizer

    assert tokenizer(public_tokenizers.path(name)).encode_batch(texts) == list(map(library(name), texts))


@pytest.mark.parametrize("name", VOCABULARIES)
def test_tokenizer_on_awkward_and_real_texts(spark, name):
    from mnemolake.llm.tokens import tokenizer

    texts = AWKWARD + [r.text for r in common.table(spark, SF, "documents").select("text").collect()]
    assert tokenizer(public_tokenizers.path(name)).encode_batch([None, *texts]) == [b"", *map(library(name), texts)]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_tokenizer_with_small_cache(name, monkeypatch):
    from mnemolake.llm import tokens

    monkeypatch.setattr(tokens, "SLICE_BYTES", 2000)
    t = WordTokenizer(public_tokenizers.path(name), cache_words=3)
    texts = [f"A{i} some words. here,\nand there {i % 7}" for i in range(1500)]
    assert t.encode_batch(texts) == list(map(library(name), texts))


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 9, 20_000).astype(np.uint32)
    counts = [0 + int(x) for x in rng.integers(1, 60, 300)]
    counts.append(len(ids) - sum(counts))
    data = token_files.pack_shard(list(range(301)), counts, ids, 8)
    s = token_files.Shard(data)
    assert (s.all() == ids).all() and len(s.rules) > 10 and len(s.symbols) < 0.6 * len(ids)
    at = np.append(0, np.cumsum(counts))
    for i in (0, 7, 300):
        assert (s.document(i) == ids[at[i] : at[i + 1]]).all() and (s.document(i, 3, 9) == ids[at[i] : at[i + 1]][3:9]).all()


def test_token_files(spark, odd, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(spark, odd, str(tmp_path / "t"), path, shard_tokens=50)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    ids = library("word_bpe_49k.json")
    want = [[*np.frombuffer(ids(r.text or ""), "<u4").tolist(), 1] for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))]
    assert [r.ids for r in got] == want and [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    crcs = sorted(token_files._decoded(spark, str(tmp_path / "t"), whole=False).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in crcs] == [(r.doc_id, r.start, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for r, w in zip(got, want)]
    token_files.write_tokens(spark, none, str(tmp_path / "e"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


# 4 and 7
def test_factorisation_identity():
    m = quality.FactorisationMachine(5, 3)
    m.w[:] = np.arange(5)
    x = np.array([1.0, 0, 2, 0.5, 0])
    direct = m.w0 + m.w @ x + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(5) for j in range(i))
    assert abs(m.raw(np.arange(5), x, np.array([0, 5]))[0] - direct) < 1e-12


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_held_out_accuracy(spark, which):
    sf = "/root/testdata/sf0.1"
    q = quality.op4_quality if which == "quality" else toxicity.op7_toxicity
    got = q(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    label = got.quality if which == "quality" else got.toxic
    assert len(got) > 500 and (got.predicted == label).mean() > 0.98 and got.score.between(0, 1).all()


def test_classifier_edges(spark, odd, none):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    q, t = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    assert quality.add_quality(spark, odd, q).where("quality_score between 0 and 1").count() == odd.count()
    assert toxicity.add_toxicity(spark, odd, t).where("toxicity_score between 0 and 1").count() == odd.count()
    assert quality.add_quality(spark, none, q).count() == 0 == toxicity.add_toxicity(spark, none, t).count()
    empty = labels.limit(0)
    assert quality.fit_quality(docs, empty).constant == 0.5 == toxicity.fit_toxicity(docs, empty).constant


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(3)
    pot, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {tags: np.exp(sum(pot[i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:]))) for tags in product((0, 1), repeat=5)}
    want = [sum(w for tags, w in weight.items() if tags[i]) / sum(weight.values()) for i in range(5)]
    got = toxicity.marginals(np.concatenate([pot[:0], pot, pot[:2]]), np.array([5, 2]), trans)
    assert np.allclose(got[:5], want)


# 5
@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=4), st.lists(st.sampled_from("abcd"), max_size=40))
def test_wu_manber_equals_brute_force(items, words):
    doc = [w.encode() for w in words]
    spans, found = decontamination.Searcher([(i, " ".join(x)) for i, x in enumerate(items)], 3).search(doc)
    hit, ids = set(), set()
    for i, item in enumerate(items):
        x = [w.encode() for w in item]
        n = min(3, len(x))
        for at in range(len(x) - n + 1) if n else ():
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == x[at : at + n]:
                    hit.update(range(p, p + n))
                    ids.add(i)
    assert {p for a, b in spans for p in range(a, b)} == hit and found == ids


def test_decontamination_passes_and_edges(spark, odd, none):
    docs, bench = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    one, many = (sorted(map(str, decontamination.find_contamination(spark, docs, bench, pass_words=n).select("doc_id", "n_words", "spans", "items").collect())) for n in (500_000, 800))
    assert one == many
    assert decontamination.find_contamination(spark, odd, bench).count() == odd.count() and decontamination.find_contamination(spark, none, bench).count() == 0
    assert decontamination.drop_contaminated(spark, odd, bench.limit(0)).columns == odd.columns
    unnamed = decontamination.find_contamination(spark, odd, spark.createDataFrame([(None, "one two")], "item_id long, text string")).where("doc_id = 3").collect()
    assert [(r.spans, r["items"]) for r in unnamed] == [([0, 2], [])] * 2
    assert decontamination.drop_contaminated(spark, odd, spark.createDataFrame([(1, "one two"), (None, None)], "item_id long, text string")).where("doc_id = 3").count() == 0


# 6
@pytest.mark.parametrize(("block", "bucket", "turn"), [(4096, 1024, 32), (16, 1024, 32), (4096, 8, 5), (4, 4, 7)])
def test_embedding_links(spark, block, bucket, turn):
    assert embedding_dedup.parameters(90, bucket=8)[0] > 1 and embedding_dedup.parameters(90, bucket=8)[1] > 5
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + rng.normal(size=base.shape) * 0.2, base[:5], base[:1] * 3]))]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (905, []), (906, [float("inf")] * 16), (907, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), block=block, bucket=bucket, turn=turn).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    n = np.bincount(a, minlength=len(u)) + np.bincount(b, minlength=len(u))
    up = ngram_join.roots(len(u), a, b)
    for i in range(len(u)):
        assert (got[i].n_links, got[i].component_id) == (n[i], up[i])
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id) == ((1, 904) if i in (904, 907) else (0, i))


def test_embedding_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, node long, keys long")
    assert embedding_dedup.near_duplicates(spark, none).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0], 1, 2), (1, [1.0, 2.0], 1, 2), (2, [2.0, 4.0], 1, 2), (None, [1.0, 2.0], 1, 2)], none.schema)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark, twice).collect()) == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1)]


def test_embedding_recall_with_many_projections(spark):
    """All links of the table and of noisy copies of it are found with buckets so small that tables have several projections."""
    u = np.array([r.embedding for r in common.table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").collect()], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    u = np.concatenate([u, u + np.random.default_rng(8).normal(size=u.shape) * np.linspace(0.01, 0.07, len(u))[:, None]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark, rows, bucket=32).collect()}
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want.sum() > 1000 and sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= n for i, n in enumerate(want.tolist()))


# 8
def test_url_rules_and_terms(spark):
    cases = {"http://a.Example.com/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"), "http://x.com/en/": ("x.com", "/en/", "com/en/", "block"), "http://xcom/en/": ("xcom", "/en/", None, "allow"), "http://q.org#a/es/": ("q.org", "", None, "allow"), "nothing": ("", "", None, "allow"), "http://h.de/casino-royale": ("h.de", "/casino-royale", None, "block"), "http://h.de/casinos": ("h.de", "/casinos", None, "allow"), "http://h.de/free/free": ("h.de", "/free/free", None, "allow"), "http://h.de/free-bonus": ("h.de", "/free-bonus", None, "block")}
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, None)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == ("", "", None, "allow")


def test_url_rules_of_contract(spark):
    """Each rule's own word, in the code and in the SQL; net/de/ is an allow rule, with a longer block rule below it."""
    import duckdb

    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for v, h, p in url_filter.RULES} == said
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://b.net/de/casino", "http://a.example.net/de/7", "http://a.example.net/de/81", "http://c.org/es/"]
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert [(r.rule, r.verdict) for r in url_filter.filter_urls(df).orderBy("page_id").collect()] == want
    assert con.sql(f"SELECT rule, verdict FROM ({url_filter.SQL['op8_url_filter']}) ORDER BY page_id").fetchall() == want


# 9
def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li>Home<li>About</ul></nav><div id=x>Menu text</div><div class=box>{0}<p>more &amp; <b>b</b>old<br>line</div><div class=f>Fixed words</div><script>if(a<b)'</p>'</script></body>"
    df = spark.createDataFrame([(i, "http://h.com/a", page.format(f"text number {i}")) for i in range(6)] + [(7, None, None), (8, "x", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(spark, df).collect()}
    assert got[3] == "text number 3"  # what all pages share is template
    assert got[7] == got[8] == ""
    assert html_extract.main_text("<main><header><h1>T</h1></header><p>a<p>b<div class=comments>c</div><aside>d</aside></main><footer>e</footer>") == "T a b"


def test_html_slots_decide_inside_articles(spark):
    teasers = ["Ten things to know", "A second teaser", "The third one"]
    page = "<html><body><nav><p>Home</p></nav><article><div class='elementor-widget-container'><h1>Title {0}</h1><p>Body {0} of some length, and words {0} of its own, on and on about what this page {0} alone is for</p></div><ul><li>{1}</li><li>{2}</li></ul><b>Fixed</b></article><div class=ad><p>Buy {0}</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://h.com/a", page.format(i, teasers[i % 3], teasers[(i // 2) % 3])) for i in range(9)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(spark, df).collect()}
    assert got[4] == "Title 4 Body 4 of some length, and words 4 of its own, on and on about what this page 4 alone is for"


def texts_of(spark, htmls, host="h.com"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", h, "c", 1) for i, h in enumerate(htmls)], "page_id long, url string, html string, host string, page int")
    return {r.page_id: r.text for r in html_extract.extract_text(spark, df).collect()}


def test_html_articles_keep_odd_names_and_recurring_sentences(spark):
    one = "<article><p>one</p><p class='notice-board'>two</p><div class='related-work'>three</div><p class='social'>four</p><h2 id='comments-on-method'>five</h2><div class='comments-area'>gone</div><div class='share-buttons'>gone</div></article>"
    assert texts_of(spark, [one])[0] == "one two three four five"
    pages = [f"<body><nav>Home</nav><article><p>Own paragraph {i}, {'x' * i}.</p><p>As the old saying goes.</p></article></body>" for i in range(5)]
    assert texts_of(spark, pages)[3] == "Own paragraph 3, xxx. As the old saying goes."


def test_html_time_grows_with_length():
    import time

    began = time.time()
    for bad in ("<a" * 100_000, "<a '" * 100_001, "<a " * 100_000 + ">", "<div>" * 30_000 + "</b1>" * 30_000, "<![CDATA[>" * 100_000, "<p>" * 30_000):
        html_extract.main_text(bad)
    assert time.time() - began < 20 and html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after") == "deep after"


def test_html_templates_raise_quality(spark):
    """Pages of plain div elements, where lists of names say nothing: share of right words with the templates and without them."""
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    menu, foot, teasers = [word(3) for _ in range(6)], word(12), [word(8) for _ in range(5)]
    truth, pages = [], []
    for i in range(20):
        own = [word(int(rng.integers(10, 60))) for _ in range(int(rng.integers(2, 6)))]
        truth.append(" ".join(own))
        pages.append(f"<body><div class=a1>{''.join(f'<div class=a2>{m}</div>' for m in menu)}</div><div class=b1>{''.join(f'<p>{x}</p>' for x in own)}</div><div class=c1>{''.join(f'<div class=c2>{teasers[k]}</div>' for k in rng.choice(5, 3, False))}</div><div class=d1>{foot}</div></body>")
    with_them = texts_of(spark, pages)
    without = {i: html_extract.main_text(h) for i, h in enumerate(pages)}
    share = lambda got: np.mean([len(set(truth[i].split())) / len(set(got[i].split()) | set(truth[i].split())) for i in range(20)])
    assert share(with_them) == 1.0 and share(without) < 0.8


def test_html_classes_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    pages = []
    for i in range(12):
        rows = "".join(f"<div class=row><h2>t{rng.integers(999)}</h2><p>x{rng.integers(999)}</p></div>" for _ in range(int(rng.integers(1, 4))))
        pages.append(f"<body><div class=top>Logo</div><div class=list>{rows}</div>" + ("<div class=extra><i>Extra</i></div>" if i % 3 else "") + "<div class=end>End</div></body>")
    tokens = [html_extract._page(p) for p in pages]
    vectors, texts = defaultdict(lambda: [0] * len(pages)), set()
    for i, (toks, paths, *_) in enumerate(tokens):
        for t, path in zip(toks, paths):
            vectors[t][i] += 1
            if path:
                texts.add(t)
    groups = defaultdict(set)
    for t, v in vectors.items():
        if sum(x > 0 for x in v) >= html_extract.MIN_PAGES:
            groups[tuple(v)].add(t)
    want = {frozenset(g) for g in groups.values() if len(g) > 1 and g - texts}
    df = spark.createDataFrame([("h", i, p) for i, p in enumerate(pages)], "host string, page long, html string")
    with common.scratch(spark) as write:
        parsed = df.select("host", "page", "html")
        parsed = write(common.streamed(parsed, html_extract._each(("host", "page", "html"), lambda host, page, html: [(host, page, *html_extract._page(html))], html_extract._PAGE), html_extract._PAGE), "pages")
        got = html_extract.classes(spark, parsed, write).collect()[0].orders
    assert {frozenset(o) for o in got} == want and len(want) == 3
    for o in got:  # one order on every page
        for toks, *_ in tokens:
            run = [t for t in toks if t in set(o)]
            assert run == o * (len(run) // len(o))


def test_html_edges(spark, none):
    assert html_extract.extract_text(spark, spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0
    df = spark.createDataFrame([(1, "http://a/b", "<p>x</p>", "h")] * 3 + [(None, None, None, None)], "page_id long, url string, html string, host string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract_text(spark, df).collect()) == [(0, "", 0)] + [(1, "x", 1)] * 3
    odd = spark.createDataFrame([(1, "http://a.com/en/x", "q", "r")] * 2 + [(None, None, None, None)], "page_id long, url string, host string, rule string")
    assert [r.rule for r in url_filter.filter_urls(odd).orderBy("page_id").collect()] == [None, "com/en/", "com/en/"] and url_filter.filter_urls(odd.limit(0)).count() == 0


def test_html_classes_are_ordered_and_nested():
    a, b, c, d = 1, 2, 3, 4
    assert [o for _, _, o in html_extract._orders("h", [a, c, b, a, b], [[b, a]])] == [[a, b]]
    assert [o for _, _, o in html_extract._orders("h", [a, b, b, a], [[b, a]])] == [[]]
    nested = html_extract._nests("h", [a, c, d, c, d, b], [[a, b], [c, d]])
    assert not any(overlaps for *_, overlaps in nested)
    assert sum(overlaps for *_, overlaps in html_extract._nests("h", [a, c, b, d], [[a, b], [c, d]])) == 1


# 10
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(lengths):
    got, room, want = packing.first_fit_decreasing(lengths, 64), [64] * (len(lengths) + 1), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        want[i] = next(b for b, r in enumerate(room) if r >= lengths[i])
        room[want[i]] -= lengths[i]
    assert got == want


def test_packing(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = library("byte_bpe_50k.json")
    docs = common.table(spark, SF, "documents")
    rows = packing.pack(spark, docs, path, group_docs=64).collect()
    texts = {r.doc_id: ids(r.text) + b"\0\0\0\0" for r in docs.collect()}
    seen, used = defaultdict(int), defaultdict(list)
    for r in rows:
        assert zlib.crc32(texts[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens * 4 == len(texts[r.doc_id])
        seen[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert all(seen[d] * 4 == len(t) for d, t in texts.items())
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(spark, odd, path).where("start = 0").count() == odd.count() and packing.pack(spark, none, path).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 99), (7, 7)]
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 99, 99: 99}


def test_pipeline_edges(spark, none):
    """Nulls, repeats, empty tables and columns that have the names of the stages' own."""
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "_quality", "_toxicity", "_spans", "_id", "_text", "h1", "node", "key"]
    schema = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names)
    text = common.table(spark, SF, "documents").orderBy("doc_id").first().text
    rows = [(i, t, *["x"] * 2, None, *["y"] * 8) for i, t in ((1, text), (1, text), (2, None), (2, ""), (None, text), (None, None), (3, text + " more words"), (4, "x " * 30000))]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
        assert corpus_pipeline.pack_sequences(spark, docs, SF).where("start = 0").count() == docs.count()
    left = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect())
    assert left == sorted([(0, text), (0, ""), (1, text), (2, ""), (2, ""), (4, "x " * 30000)])


def test_deduplicate_tells_rows_of_one_id_apart(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (2, "something else that no other document has in it"), (5, base.upper()), (1, base + "!")]
    got = sorted(tuple(r) for r in ngram_join.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 2 and got[1] == rows[2] and got[0][0] == 1


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(spark, stage(spark, at, SF), name)
        assert after.columns == docs.columns and 0 < after.count() <= at.count()
        assert after.exceptAll(at).count() == 0
        at = after
    ids = {r.doc_id for r in at.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == ids
    assert not brute([r.text for r in at.collect()])
    assert decontamination.find_contamination(spark, at, common.table(spark, SF, "benchmark")).where("size(spans) > 0").count() == 0
