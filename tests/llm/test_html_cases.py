"""Pages that lost or kept the wrong text before, and tags of any shape."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm import html_extract

from .test_operators import texts_of

PAGE = "<html><body><nav><ul><li>Home</li><li>News</li></ul></nav><article><h1>{0}</h1>{1}</article><footer>Fixed words below</footer></body></html>"


def test_repeated_pages_do_not_make_another_pages_article_furniture(spark):
    alike = PAGE.format("One title", "<p>First words of one.</p><p>Second words of one.</p>")
    other = PAGE.format("Other title", "<div><p class='byline'>By Jane Roe</p></div><p>First words of the other.</p><p>Second words of the other.</p>")
    got = texts_of(spark, [alike, alike, alike, other])
    assert got == {0: (one := "One title First words of one. Second words of one."), 1: one, 2: one, 3: "Other title By Jane Roe First words of the other. Second words of the other."}


def test_bylines_stay_however_often_they_recur(spark):
    got = texts_of(spark, [PAGE.format(f"Title {i}", f"<p class='byline'>By Jane Roe</p><p>Words {i} of its own, {'more ' * i}.</p>") for i in range(5)])
    assert got == {i: f"Title {i} By Jane Roe Words {i} of its own, {' '.join(['more'] * i)}{' ' if i else ''}." for i in range(5)}


def test_adverts_inside_lines_go():
    text = html_extract.main_text
    assert text("<article><p>One <span class=\"advert\">BUY <span>NOW</span> it</span> two <a class='ad' href='x'>AD</a><b>three</b></p></article>") == "One two three"
    assert text("<article><p>a <span hidden>no</span> b <a href='/x' title='class'>c</a> <em id=e>d</em></p><p>e <span role=alert>f</span></p></article>") == "a b c d e"
    assert text("<article><p>a <span class='ad'>never closed</p><p>b</p></article>") == "a b"
    assert text("<article><a class='ad'><div>block <b>in</b> it</div></a><p>after</p></article>") == "after"


def test_small_host_by_hand(spark):
    """What a reader would copy from each of four pages."""
    pages = [PAGE.format(t, f"<aside>Also read {i}</aside><p>{a} <i>{b}</i></p><ul><li>{c}</li></ul><div class='comments'><p>Nice {i}!</p></div>") for i, (t, a, b, c) in enumerate([("Tea", "How tea", "grows.", "Leaf"), ("Rain", "Why it", "rains.", "Cloud"), ("Salt", "Where salt", "comes from.", "Sea"), ("Wool", "Who makes", "wool.", "Sheep")])]
    assert texts_of(spark, pages) == {0: "Tea How tea grows. Leaf", 1: "Rain Why it rains. Cloud", 2: "Salt Where salt comes from. Sea", 3: "Wool Who makes wool. Sheep"}


def plain_tags(source: str) -> list[tuple[str, str]]:
    """Names and attributes of tags by trying every tag on its own, in quadratic time."""
    out, at = [], 0
    while (i := source.find("<", at)) >= 0:
        name = html_extract._NAME.match(source, i + 1)
        if not name or ">" not in source[i:]:
            at = i + 1
            continue
        stop = name.end()
        while stop < len(source) and source[stop] != ">":
            m = html_extract.re.compile("=\\s*([\"'])").match(source, stop)
            if m:
                end = source.find(m[1], m.end())
                stop = end + 1 if end >= 0 else len(source)
            else:
                stop += 1
        if stop >= len(source):
            stop = source.find(">", name.end())
        out.append((name[0].lower(), source[name.end() : stop]))
        at = stop + 1
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<a", "<b ", " x=", "'", '"', ">", "=", " ", "y", "<", "<p>"]), max_size=30))
def test_tags_equal_plain_scan(parts):
    source = "".join(parts)
    assert [(n, a) for _, _, n, a, closes in html_extract.tags_of(source) if n and not closes] == plain_tags(source)


def test_time_grows_with_length_whatever_the_quotes():
    rng = random.Random(1)
    shapes = ["<a '>' \"", "<a x='>' y=\"", "<a x=\"'>", "<a x='", "<b y=\">\" ", "<a x= ' y='>", "=\"<a", "<a class='ad'>x", "<span class=ad><span>"]
    for shape in [*shapes, *("".join(rng.choice(["<a", " x=", "'", '"', ">", "<b c=", "t"]) for _ in range(9)) for _ in range(8))]:
        began = time.time()
        html_extract.main_text(shape * (300_000 // len(shape)))
        assert time.time() - began < 20, shape
