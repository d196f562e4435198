"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

Tokens are elements told apart by their path, and texts of blocks told apart by path and content. The pages of
a host give each token an occurrence vector; tokens that share one form a class. Classes that are not in one order
on all pages or do not nest are dropped. A text in a class belongs to the template, and the slots between the
tokens of the classes hold what pages fill in. Slots whose texts mostly recur on other pages are left out; lists of
elements and words give hints on the others.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch, streamed, table, written
from .url_filter import split_url

#: Pages on which a token must stand for its class to count.
MIN_PAGES = 3
#: Values of all hosts' lists that may be broadcast (8 bytes each), and copies of larger ones.
LISTED, SALTS = 4_000_000, 32
#: Share of a slot's blocks, and of their characters, that must recur on other pages for it to be furniture.
RECUR = 0.5
#: Share of a host's text, the template's too, above which an element is no furniture, whatever the lists say.
MOST = 2 / 3

# Fixed values of HTML: elements without content, with raw text, and those that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and roles that hold page furniture.
FURNITURE = frozenset("head nav footer aside form button select menu dialog script style textarea noscript template iframe svg object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class or id: a name that is made of these, and of general ones besides, marks furniture. Outside an article those of OUTSIDE do too.
WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond disqus toolbar pager pagination".split())
GENERAL = frozenset("area articles bar block body bottom box button buttons center column container content entry footer form global group header holder inner items left left link links list main menu outer page panel post posts reader right root section site slot text thread title top unit user wrap wrapper".split())
OUTSIDE = frozenset("header masthead topbar".split())
#: Names of an article's own parts: on elements of running text inside an article they mark what is no template, however often it recurs.
OWN = frozenset("byline author authors writer credit credits dateline date published updated headline heading title subtitle lead lede intro summary abstract standfirst dek caption".split())
#: Elements of running text, and the words that mark even these.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li td th tr figcaption".split())
PLAIN = frozenset("ad ads advert adverts advertisement advertising sponsored promo cookie cookies newsletter breadcrumb breadcrumbs".split())
MAIN = frozenset("article main".split())
#: Open elements at most; deeper ones stand beside each other, as in browsers. No text is lost by it.
DEPTH = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("=\\s*([\"'])|>")
_MARKS = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Open elements of these names end when the next one begins, or a block does.
_CLOSES = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


@lru_cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


def _names(value: str, words: frozenset) -> bool:
    """Whether a name in a class or id is made of these words, single letters and general ones."""
    for name in value.split():
        own = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in words for w in own) and all(w in words or w in GENERAL or len(w) == 1 for w in own):
            return True
    return False


class Element:
    """path is a hash of the names above and its own; region that of the outermost element of furniture around it, 0 for none.

    marked says that the element itself is furniture, own that it is a named part of an article.
    """

    __slots__ = ("furniture", "main", "marked", "name", "own", "path", "region")

    def __init__(self, name: str, attrs: str, above: Element | None):
        self.name = name
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs and not attrs.isspace() else {}
        called = f"{found.get('class', '')} {found.get('id', '')}" if found else ""
        words = sorted(set(re.split(r"[^a-z]+", called)) - {""}) if called else ()
        self.path = _key(str(above.path) if above else "", name, *words)
        inside = above.main if above else False
        hidden = bool(found) and ("hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""))
        page = name in ("html", "body")
        named = bool(words) and not page and (_names(called, PLAIN if name in TEXTUAL or name in INLINE else WORDS) or (not inside and _names(called, OUTSIDE)))
        outside = not inside and name == "header"
        self.marked = name in FURNITURE or found.get("role", "") in ROLES or hidden or named or outside
        self.furniture = bool(above and above.furniture) or self.marked
        self.region = (above.region if above and above.furniture else self.path) if self.furniture else 0
        self.main = inside or ((name in MAIN or found.get("role") == "main" or found.get("itemprop") == "articlebody") and not self.furniture)
        self.own = inside and name in TEXTUAL and bool(words) and _names(called, OWN)


def tags_of(source: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, whether it closes) of each tag, in one pass; comments and the like have an empty name.

    Send a position to go on from there. A quote opens after an equals sign only. A tag whose quotes do not end goes up to its
    first `>`; a `<` after which no `>` comes is text. Places from which no tag ends are remembered, so that no other tag looks
    on from them.
    """
    dead: set[int] = set()
    at, last, data = 0, source.rfind(">"), source.rfind("]]>")
    while True:
        i = source.find("<", at)
        if i < 0 or i > last:
            return
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            at = end + 3 if end >= 0 else len(source)
            yield i, at, "", "", False
            continue
        if i < data and source.startswith("<![CDATA[", i):
            at = source.find("]]>", i) + 3
            yield i, at, "", "", False
            continue
        if source[i + 1 : i + 2] in ("!", "?"):
            at = source.find(">", i) + 1
            yield i, at, "", "", False
            continue
        closes = source.startswith("/", i + 1)
        name = _NAME.match(source, i + 1 + closes)
        if not name:
            at = i + 1
            continue
        stop, passed = name.end(), []
        while True:
            passed.append(stop)
            m = None if stop in dead else _STOP.search(source, stop)
            end = source.find(m[1], m.end()) if m and m[1] else 0
            if not m or end < 0:
                dead.update(passed)
                stop = source.find(">", name.end())
                break
            if not m[1]:
                stop = m.start()
                break
            stop = end + 1
        at = stop + 1
        to = yield i, at, name[0].lower(), source[name.end() : stop], closes
        if to is not None:
            at = to
            yield 0, 0, "", "", False


def blocks_of(source: str | None) -> tuple[list[tuple[Element, str]], Counter, list[tuple[Element, str | None]]]:
    """(element, text) of every block with text, in page order, how often each path occurs, and blocks and elements (text None) in order."""
    source = source or ""
    stack: list[Element] = []
    blocks: list[tuple[Element, str]] = []
    paths: Counter = Counter()
    events: list[tuple[Element, str | None]] = []
    root = Element("html", "", None)
    text: list[str] = []
    opened: Counter = Counter()
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                blocks.append((stack[-1] if stack else root, joined))
                events.append(blocks[-1])
            text.clear()

    def leave(keep: int) -> None:
        for e in stack[keep:]:
            opened[e.name] -= 1
        del stack[keep:]

    tags = tags_of(source)
    for start, end, name, attrs, closes in tags:
        if start > at:
            text.append(source[at:start])
        at = max(at, end)
        if not name:
            continue
        if closes:
            if name in INLINE or name in VOID:
                if name == "br":
                    text.append(" ")
                if not opened[name]:
                    continue
            if opened[name]:
                flush()
                leave(max(i for i, e in enumerate(stack) if e.name == name))
            elif name == "p":
                flush()
            continue
        if name in INLINE and name != "wbr" and not opened[name]:
            # inside a line only what is furniture by itself counts as an element, and those of its name in it
            if not _MARKS.search(attrs) or not Element(name, attrs, stack[-1] if stack else root).marked:
                continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
            continue
        if name in RAW:
            close = _raw_end(name).search(source, at)
            at = close.end() if close else len(source)
            tags.send(at)
            continue
        flush()
        while stack and stack[-1].name == "p" and name not in INLINE:  # a block ends an open paragraph
            leave(len(stack) - 1)
        if name in _CLOSES and _CLOSES[name]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in _BARRIER[name]:
                    break
                if stack[i].name in _CLOSES[name]:
                    leave(i)
                    break
        if name == "html" and not stack:
            stack.append(root)
        else:
            if len(stack) >= DEPTH:
                leave(DEPTH - 1)
            stack.append(Element(name, attrs, stack[-1] if stack else root))
        opened[name] += 1
        paths[stack[-1].path] += 1
        events.append((stack[-1], None))
    text.append(source[at:])
    flush()
    return blocks, paths, events


def _walk(tokens: list[int], place: dict[int, tuple[int, int, int]]) -> tuple[list[tuple[int, int]], dict[int, set]]:
    """For each token the (class, gap) it stands in, and of each class the gaps it opens in; None marks one that overlaps another.

    place: token -> (class, position in its order, tokens of the class).
    """
    stack: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    above: dict[int, set] = {}
    sizes = {cls: size for cls, _, size in place.values()}
    for t in tokens:
        at = place.get(t)
        if at is None or at[1] == 0:
            gaps.append((stack[-1][0], stack[-1][1]) if stack else (0, 0))
        if at is None:
            continue
        cls, i, size = at
        if i == 0:
            above.setdefault(cls, set()).add(gaps[-1])
            stack.append([cls, 0])
        else:
            while stack and stack[-1][0] != cls:  # overlaps; the smaller class goes
                above.setdefault(min(cls, stack.pop()[0], key=lambda c: (sizes[c], c)), set()).add(None)
            if not stack:
                stack.append([cls, i])
            stack[-1][1] = i
            gaps.append((cls, i))
            if i == size - 1:
                stack.pop()
    return gaps, above


def _placed(orders: list[list[int]] | None) -> dict[int, tuple[int, int, int]]:
    return {t: (_key(*map(str, o)), i, len(o)) for o in orders or () for i, t in enumerate(o)}


def _slot(gap: tuple[int, int], path: int) -> int:
    return _key(str(gap[0]), str(gap[1]), str(path))


_PAGE = "host string, page long, tokens array<long>, paths array<long>, hints array<int>, regions array<long>, chars array<int>"


def _page(source: str | None) -> tuple[list, list, list, list, list]:
    """tokens of a page in order; for texts also the path, the hint of the lists (1 furniture, 2 main, 4 a part of an article), its outermost element, and characters."""
    tokens, paths, hints, regions, chars = [], [], [], [], []
    for element, text in blocks_of(source)[2]:
        tokens.append(element.path if text is None else _key(str(element.path), text))
        paths.append(element.path if text is not None else 0)
        hints.append(element.furniture + 2 * element.main + 4 * element.own)
        regions.append(element.region)
        chars.append(len(text or ""))
    return tokens, paths, hints, regions, chars


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _each(columns: tuple[str, ...], rows_of, schema: str):
    """Runs rows_of(values of a row) over batches, 256 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield _batch([r for row in zip(*(part.column(c).to_pylist() for c in columns)) for r in rows_of(*row)], schema)

    return run


def _seen(host, page, tokens, paths, hints, chars):
    found = Counter(zip(tokens, paths, hints, chars))
    for (t, path, hint, c), n in found.items():
        h = xxhash.xxh3_64_intdigest(f"{page} {n}")
        yield host, t, path, n, n * c, hint >> 2, h & 0xFFFFFFFF, h >> 32


def _orders(host, tokens, members):
    """The order of each class on a page; empty where its tokens do not repeat in one order."""
    cls = {t: i for i, m in enumerate(members) for t in m}
    runs: dict[int, list[int]] = {}
    for t in tokens:
        if t in cls:
            runs.setdefault(cls[t], []).append(t)
    for i, run in runs.items():
        k = len(members[i])
        first = run[:k]
        yield host, min(members[i]), first if len(set(first)) == k and run == first * (len(run) // k) else []


def _nests(host, tokens, orders):
    place = _placed(orders)
    for cls, gaps in _walk(tokens, place)[1].items():
        for g in gaps:
            yield host, cls, _key("overlaps") if g is None else _key(*map(str, g)), int(g is None)


def _filled(host, tokens, paths, hints, regions, chars, orders):
    """The texts of a page by slot, first being 1 once a slot; those of the template in slot 0."""
    place = _placed(orders)
    found: dict[tuple, list[int]] = {}
    for t, gap, path, hint, region, n in zip(tokens, _walk(tokens, place)[0], paths, hints, regions, chars):
        if path:
            at = found.setdefault((0 if t in place else _slot(gap, path), t, hint, region), [0, 0])
            at[0] += 1
            at[1] += n
    begun = set()
    for (slot, t, hint, region), (n, c) in found.items():
        yield host, slot, t, hint, region, n, c, int(slot not in begun)
        begun.add(slot)


def with_hosts(pages: DataFrame, hosts: DataFrame, *lists: str, how: str = "inner") -> DataFrame:
    """pages joined to hosts, a written table of one row a host with columns of lists.

    It is broadcast if its lists hold at most LISTED values in all. Otherwise it is copied SALTS times and each host's
    pages are dealt over the copies, so that a host with most pages is no single task.
    """
    held = hosts.agg(F.coalesce(F.sum(sum((F.size(F.flatten(c)) if hosts.schema[c].dataType.elementType.typeName() == "array" else F.size(c)) for c in lists) + 16), F.lit(0))).first()[0]
    if held <= LISTED:
        return pages.join(F.broadcast(hosts), "host", how)
    salted = pages.withColumn("salt", F.pmod(F.xxhash64(*pages.columns), F.lit(SALTS)))
    return salted.join(hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long")), ["host", "salt"], how).drop("salt")


def classes(spark: SparkSession, parsed: DataFrame, write: Callable) -> DataFrame:
    """host, orders: the valid classes of each host, as their tokens in order.

    Occurrence vectors are never gathered: each is summed into a fingerprint of (page, count), which map-side
    aggregation makes one row per task and token, so a host with most pages is no larger than others. A text whose
    path mostly holds texts of single pages, or is a named part of an article, is no token of a template, however often it recurs. A class has
    two tokens at least, an element among them. It is valid if its tokens repeat in one order on every page, and
    all its occurrences lie in one gap of the other valid classes; the rest go, until none does.
    """
    schema = "host string, token long, path long, n long, chars long, part int, lo long, hi long"
    names = ("host", "page", "tokens", "paths", "hints", "chars")
    vectors = streamed(parsed.select(*names), _each(names, _seen, schema), schema).groupBy("host", "token", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max("part").alias("part"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    vectors = write(vectors, "vectors")
    share = lambda c: F.sum(F.when(F.col("pages") >= MIN_PAGES, F.col(c)).otherwise(0)) <= RECUR * F.sum(c)
    own = vectors.where("path <> 0").groupBy("host", "path").agg((share("n") | share("chars") | (F.max("part") == 1)).alias("own")).where("own").select("host", "path")
    members = vectors.where(F.col("pages") >= MIN_PAGES).join(own, ["host", "path"], "left_anti").groupBy("host", "lo", "hi").agg(F.min((F.col("path") != 0).cast("int")).alias("text"), F.collect_set("token").alias("tokens")).where("text = 0 and size(tokens) > 1")
    members = write(members.groupBy("host").agg(F.collect_list("tokens").alias("members")), "classes")
    schema = "host string, cls long, order array<long>"
    seen = streamed(with_hosts(parsed.select("host", "tokens"), members, "members"), _each(("host", "tokens", "members"), _orders, schema), schema)
    ordered = seen.groupBy("host", "cls").agg(F.min("order").alias("order"), F.max("order").alias("last")).where("order = last and size(order) > 1")
    now = write(ordered.groupBy("host").agg(F.collect_list("order").alias("orders")), "orders")
    schema, left = "host string, cls long, gap long, overlaps int", "host string, orders array<array<long>>"
    while True:
        seen = streamed(with_hosts(parsed.select("host", "tokens"), now, "orders"), _each(("host", "tokens", "orders"), _nests, schema), schema)
        bad = write(seen.groupBy("host", "cls").agg(F.min("gap").alias("gap"), F.max("gap").alias("last"), F.max("overlaps").alias("overlaps")).where("gap <> last or overlaps = 1").groupBy("host").agg(F.collect_set("cls").alias("bad")), "overlaps")
        if bad.isEmpty():
            return now
        rest = now.join(bad, "host", "left").select("host", "orders", F.coalesce("bad", F.array().cast("array<long>")).alias("bad"))
        now = write(streamed(rest, _valid, left), "orders")


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [[o for o in orders if _key(*map(str, o)) not in set(bad)] for orders, bad in zip(batch.column("orders").to_pylist(), batch.column("bad").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(left, pa.list_(pa.list_(pa.int64())))], ["host", "orders"])


def templates(spark: SparkSession, pages: DataFrame, write: Callable) -> DataFrame:
    """host, orders (valid classes), keep, leave (slots with main text, slots of furniture), from pages (host, page, html), those with one `page` being copies that count once.

    A slot is a path in a gap between two tokens of a class. It is left out if most of its blocks, and of their characters, recur on other
    pages, in article or main on two others. The lists only hint: their furniture is left out unless its outermost element holds over MOST of the
    host's text in slots that do not recur; what is outside article or main goes too if those hold over half of the rest.
    """
    parsed = streamed(pages, _each(("host", "page", "html"), lambda host, page, html: [(host, page, *_page(html))], _PAGE), _PAGE)
    # each task passes on one of its copies at most, so a page of which there are very many is no single task
    one = F.row_number().over(Window.partitionBy("host", "page").orderBy("page"))
    parsed = write(parsed.withColumn("copy", one).where("copy = 1").drop("copy"), "pages")
    orders = classes(spark, parsed, write)
    schema = "host string, slot long, token long, hint int, region long, n long, chars long, first int"
    names = ("host", "tokens", "paths", "hints", "regions", "chars", "orders")
    filled = streamed(with_hosts(parsed.drop("page"), orders, "orders", how="left").select(*names), _each(names, _filled, schema), schema)
    texts = filled.groupBy("host", "slot", "token", "hint", "region").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("first").alias("first"))
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    furniture, main, part = (F.col("hint").bitwiseAND(bit) == bit for bit in (1, 2, 4))
    again = ~part & (F.col("pages") >= F.when(main, MIN_PAGES).otherwise(2))
    slots = texts.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum("first").alias("pages"), total("n", again).alias("again"), total("chars", again).alias("again_chars"), total("n", furniture).alias("furniture"), total("n", main).alias("main"), F.max("region").alias("region"), F.sum("chars").alias("chars"))
    slots = write(slots.select("host", "slot", "pages", ((F.col("again") > RECUR * F.col("n")) & (F.col("again_chars") > RECUR * F.col("chars"))).alias("recurs"), (F.col("furniture") * 2 > F.col("n")).alias("furniture"), (F.col("main") * 2 > F.col("n")).alias("main"), "region", "chars"), "slots")
    hosts = slots.groupBy("host").agg(F.sum("chars").alias("all"), total("chars", (F.col("slot") != 0) & ~F.col("furniture")).alias("plain"), total("chars", (F.col("slot") != 0) & ~F.col("furniture") & F.col("main")).alias("inside"))
    regions = slots.where("furniture and not recurs").groupBy("host", "region").agg(F.sum("chars").alias("held"))
    judged = slots.where(F.col("pages") >= MIN_PAGES).join(hosts, "host", "left").join(regions, ["host", "region"], "left")
    kept = ~F.col("recurs") & F.when(F.col("furniture"), F.col("held") > MOST * F.col("all")).otherwise(F.col("main") | (F.col("inside") * 2 <= F.col("plain")))
    verdicts = judged.groupBy("host").agg(F.collect_set(F.when(kept, F.col("slot"))).alias("keep"), F.collect_set(F.when(~kept, F.col("slot"))).alias("leave"))
    return orders.join(verdicts, "host", "full_outer")


def main_text(source: str | None, orders: list[list[int]] = (), keep: set[int] = frozenset(), leave: set[int] = frozenset()) -> str:
    """What the slots of a page hold that are no furniture, in page order; the lists decide on slots of no verdict only."""
    blocks, _, events = blocks_of(source)
    place = _placed(orders)
    inside = any(e.main and not e.furniture for e, _ in blocks)
    listed = lambda e: not e.furniture and (e.main or not inside)
    filled = []
    tokens = [e.path if t is None else _key(str(e.path), t) for e, t in events]
    for (e, text), token, gap in zip(events, tokens, _walk(tokens, place)[0]):
        if text is None or token in place:
            continue
        slot = _slot(gap, e.path)
        if slot in keep or (slot not in leave and listed(e)):
            filled.append(text)
    return " ".join(filled)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            out = [main_text(s, o or (), set(k or ()), set(v or ())) for s, o, k, v in zip(*(part.column(c).to_pylist() for c in ("html", "orders", "keep", "leave")))]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html); further columns are not read.

    A null html is empty and has an empty text, a null url belongs to the host "" like one without `://`. Pages of
    one html count once in their host's template. Hosts with fewer than three different pages have no template of their
    own; the lists alone tell their furniture.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), split_url(F.col("url"))[0].alias("host"))
    with scratch(spark) as write:
        found = written(spark, templates(spark, own.select("host", F.xxhash64("html").alias("page"), "html"), write), "templates")
    return streamed(with_hosts(own, found, "orders", "keep", "leave", how="left").select("page_id", "url", "html", "orders", "keep", "leave"), _extract, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark, table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
SQL: dict[str, str] = {}
