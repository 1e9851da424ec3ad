"""HTML extraction: nearest-URL page differencing, checked by article marks.

Every page is cut into all its text blocks. All pages are ordered by URL path
within their host and each is aligned, block by block, with the page before and
the page after by longest common subsequence: what a neighbour has too is taken
for the template of the host, what is left for the page's own text. Marks of the
page check this. A block whose element is no content by its tag, role or class,
or that stands outside the article (``article``, ``main`` or ``role=main``) of a
page that marks one, is template, shared or not. A block of the article is
content, shared or not, as two articles may have a paragraph in common. The
differencing alone decides on blocks that the marks leave open, the doubtful
ones: all others of a page that marks no article, and those in an article whose
class or id names template words among others (``share-price``, ``ad-hoc``).

Blocks of equal text are the same block if both stand in an article, both in
elements of no content, or neither does: a paragraph that a neighbour has in its
article is no template. Texts are compared by 62 bits of their hash, so that only
codes go through the ordering; the texts are cut again and joined to what the
differencing found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table
from .words import tidy

_MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][\w:-]*)|[!?/])")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WHITE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_CUT = re.compile(r"[^a-z0-9]+")

# Element names and the words of class, id and role by their part in a page.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav footer aside form button menu dialog head".split())
NOT_CONTENT = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus related recommended share sharing social footer masthead popup modal overlay complementary contentinfo search dialog toolbar widget widgets skip".split())
#: Words that stand beside these in names of elements and mean nothing by themselves.
AROUND = set("area article articles bar block body bottom box button buttons card column container content desktop fixed form global head header heading icon icons inner item items js left link links list main message mobile outer page panel policy post posts primary right row secondary section site sticky text title top wrap wrapper".split())
RAW = set("script style noscript template textarea select iframe svg title object".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@lru_cache(maxsize=4096)
def name_of(name: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role names no content, perhaps none, a header."""
    words = set(filter(None, _CUT.split(_CAMEL.sub("-", name).lower())))
    some, only = bool(words & NOT_CONTENT), words <= NOT_CONTENT | AROUND
    return some and only, some and not only, "header" in words and only


def _parts(attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """No content, perhaps none, header by class, id and role; hidden; main."""
    none = maybe = header = hidden = main = False
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        low = value.lower()
        if name == "hidden" or (name == "aria-hidden" and low == "true") or (name == "style" and re.search(r"display\s*:\s*none", low)):
            hidden = True
        elif name in ("class", "id", "role"):
            for token in value.split():
                found = name_of(token)
                none, maybe, header = none | found[0], maybe | found[1], header | found[2]
        main |= (name == "role" and low == "main") or (name == "itemprop" and low == "articlebody")
    return none, maybe, header, hidden, main


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of all markup in order; comments and declarations have no name.

    Takes time in proportion to the text: what is never closed is looked for once.
    """
    last = {c: html.rfind(c) for c in (">", "'", '"')}
    at = 0
    while m := _MARKUP.search(html, at):
        start, at = m.span()
        name = (m[2] or "").lower()
        if html.startswith("<!--", start):
            end = html.find("-->", start + 2)
            at = len(html) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if at > last[">"]:
            return  # no markup ends behind this point
        end, i = -1, at
        while end < 0:
            stop = _STOP.search(html, i)
            if stop[0] == ">" or not name:
                end = stop.start() if stop[0] == ">" else html.index(">", stop.start())
            elif not html[at : stop.start()].rstrip().endswith("=") if stop.start() - at < 4096 else html[stop.start() - 1] != "=":
                i = stop.end()  # a quote inside a name or a value
            elif last[stop[0]] <= stop.start():
                end = html.index(">", stop.start())
            else:
                i = html.index(stop[0], stop.end()) + 1
                if i > last[">"]:  # the quote swallows the last end of a tag
                    end = html.index(">", stop.start())
        attributes = html[at:end]
        at = end + 1
        if name in RAW and not m[1]:
            close = _RAW_END[name].search(html, at)
            at = close.end() if close else len(html)
            name = attributes = ""
        yield start, at, m[1] or "", name, attributes


def pieces(html: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, in the article, doubtful, template by its tags) of every block, in page order."""
    out: list[tuple[str, bool, bool, bool]] = []
    held: list[str] = []
    beside: list[str] = []  # text of skipped elements
    stack: list[tuple[str, bool, bool, bool]] = []  # name, skipped, article, doubtful
    open_tags: Counter[str] = Counter()
    skip = article = doubt = 0

    def flush() -> None:
        for parts in (beside, held):
            text = _WHITE.sub(" ", "".join(parts)).strip() if parts else ""
            if text:
                out.append((text, article > 0, doubt > 0, parts is beside))
            parts.clear()

    def close(upto: int) -> None:
        nonlocal skip, article, doubt
        for name, skipped, inside, doubtful in stack[upto:]:
            open_tags[name] -= 1
            skip -= skipped
            article -= inside
            doubt -= doubtful
        del stack[upto:]

    at = 0
    for start, end, slash, tag, attributes in tags(html):
        if start > at:
            (beside if skip else held).append(unescape(html[at:start]))
        at = end
        if not tag:
            continue
        if slash:
            if tag in BLOCKS:
                flush()
            if open_tags[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if doubt or stack[i][3]:
                    flush()
                close(i)
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            held.append(" ")
            if skip:
                beside.append(" ")
        if tag in EMPTY or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag == "p" and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        none, maybe, header, hidden, main = _parts(attributes) if attributes.strip() else (False,) * 5
        page = tag in ("html", "body")
        none, maybe = none and not page, maybe and not page
        starts = (tag in ("article", "main") or main) and not none and not hidden
        if starts and skip and not article:  # an element before the article was never closed
            close(0)
        skipped = not starts and (tag in OUTSIDE or none or hidden or (not article and (tag == "header" or header and not page and tag != "h1")))
        if maybe and tag not in BLOCKS:
            flush()
        stack.append((tag, skipped, starts, maybe))
        open_tags[tag] += 1
        skip += skipped
        article += starts
        doubt += maybe
    if at < len(html):
        (beside if skip else held).append(unescape(html[at:]))
    flush()
    return out


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """(text, in the article, doubtful) of every block that is not template by its tags, in page order."""
    return [piece[:3] for piece in pieces(html) if not piece[3]]


#: What marks say of a block: no content by its element, content, nothing, or outside the article that the page marks.
TEMPLATE, ARTICLE, DOUBTFUL, BESIDE = 0, 1, 2, 3


def judged(html: str) -> list[tuple[str, int]]:
    """(text, what the page's marks say of it) of every block, in page order."""
    found = pieces(html)
    marked = any(inside and not template for _, inside, _, template in found)
    return [(text, TEMPLATE if template else BESIDE if marked and not inside else DOUBTFUL if doubtful or not marked else ARTICLE) for text, inside, doubtful, template in found]


PAIRS = 64  # equal pairs of lines a line, beyond which a split of the alignment is found by bits instead of pairs


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of a and b[:j] for each j; a row of the table is one number of len(b) bits."""
    places = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    cache: dict = {}
    full = row = (1 << len(b)) - 1
    for line in a:
        bits = cache.get(line)
        if bits is None:
            where = places.get(line)
            if where is None:
                continue
            ones = bytearray(len(b) // 8 + 1)
            for j in where:
                ones[j >> 3] |= 1 << (j & 7)
            bits = int.from_bytes(ones, "little")
            if len(where) > PAIRS:
                cache[line] = bits
        hit = row & bits
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence of a and b."""
    out: set[int] = set()
    todo = [(0, a, b)]
    while todo:
        base, a, b = todo.pop()
        low = 0
        while low < len(a) and low < len(b) and a[low] == b[low]:
            low += 1
        high = 0
        while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
            high += 1
        out.update(range(base, base + low), range(base + len(a) - high, base + len(a)))
        a, b, base = a[low : len(a) - high], b[low : len(b) - high], base + low
        count = Counter(b)
        if sum(count[line] for line in a) <= PAIRS * (len(a) + len(b)) or len(a) < 2:
            out.update(base + i for i in _by_pairs(a, b))
            continue
        half = len(a) // 2
        at = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        todo += [(base, a[:half], b[:at]), (base + half, a[half:], b[at:])]
    return out


def _by_pairs(a: list, b: list) -> set[int]:
    places = defaultdict(list)
    for j in range(len(b) - 1, -1, -1):
        places[b[j]].append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _key(page: int | None, url: str | None, html: str | None) -> bytes:
    """Of a row by its content; equal rows have equal neighbours."""
    return hashlib.blake2b(f"{page} {url!r} {html is None} {html}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _code(text: str, kind: int) -> int:
    """62 bits of the text's hash and the kind in the lowest two."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) & ~3 | kind


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


_LONGS = pa.list_(pa.int64())


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html) in; a key and the codes of all blocks out."""
    for batch in batches:
        rows = []
        for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((_key(page, url, html), page, url, [_code(*b) for b in judged(html or "")]))
        yield _batch(rows, ["key", "page_id", "url", "codes"], [pa.binary(), pa.int64(), pa.string(), _LONGS])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html) in; a key and the texts of the blocks that marks leave in out."""
    for batch in batches:
        rows = []
        for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((_key(page, url, html), page, url, [t for t, kind in judged(html or "") if kind in (ARTICLE, DOUBTFUL)]))
        yield _batch(rows, ["key", "page_id", "url", "blocks"], [pa.binary(), pa.int64(), pa.string(), pa.list_(pa.string())])


def _open(codes: list[int]) -> list[int]:
    """Those of the blocks that marks leave in."""
    return [c for c in codes if c & 3 in (ARTICLE, DOUBTFUL)]


def _lines(codes: list[int]) -> list[int]:
    """What is aligned: an equal text is the same block in an article, in elements of no content, or anywhere else."""
    return [c & ~1 if c & DOUBTFUL else c for c in codes]


def _differ(codes: list[int], before: list[int] | None, after: list[int] | None) -> tuple[int, list[int]]:
    """How many of the blocks that marks leave in a neighbour has too, and which of them go, by place among them."""
    lines = _lines(codes)
    both: set[int] = set()
    for near in (before, after):
        if near:
            both |= shared(lines, _lines(near))
    own = [i for i, c in enumerate(codes) if c & 3 in (ARTICLE, DOUBTFUL)]
    return sum(i in both for i in own), [k for k, i in enumerate(own) if i in both and codes[i] & 3 == DOUBTFUL]


_UNIT = "key binary, n_shared int, gone array<int>, part int, last boolean, host string, codes array<long>, tail array<long>, before array<long>, after array<long>"
_NAMES = [x.split()[0] for x in _UNIT.split(", ")]
_TYPES = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.string(), _LONGS, _LONGS, _LONGS, _LONGS]


class _Run:
    """Neighbouring rows of which marks leave in the same blocks."""

    def __init__(self, host: str, codes: list[int], mine: list[int]):
        self.host, self.mine, self.head, self.tail = host, mine, codes, codes
        self.rows: dict[bytes, list[int]] = {}

    def add(self, key: bytes, codes: list[int]) -> None:
        self.tail = self.tail if codes == self.tail else codes
        self.rows[key] = self.tail


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, host, codes) of one range in order in; what goes of each row out.

    The neighbours of a row are the rows before and after its run. The first and
    the last run of the range lack one: their rows come back as they are, after
    a row without a key that holds the run's first and last codes and the one
    neighbour it has.
    """
    part = TaskContext.get().partitionId()
    runs: list[_Run] = []  # the last three at most
    first, out = True, []

    def settle(before: _Run | None, run: _Run, after: _Run | None, last: bool | None = None) -> None:
        left = before.tail if before and before.host == run.host else None
        right = after.head if after and after.host == run.host else None
        if last is not None:
            out.append((None, None, None, part, last, run.host, run.head, run.tail, left, right))
            out.extend((key, None, None, part, last, None, codes, None, None, None) for key, codes in run.rows.items())
            return
        had, found = None, (0, [])
        for key, codes in run.rows.items():
            if codes is not had:
                had, found = codes, _differ(codes, left, right)
            out.append((key, *found, None, None, None, None, None, None, None))

    for batch in batches:
        for key, host, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            mine = _open(codes)
            if not (runs and runs[-1].host == host and runs[-1].mine == mine):
                if len(runs) == 2 and first:
                    settle(None, runs[0], runs[1], False)
                    first = False
                if len(runs) == 3:
                    settle(*runs)
                    del runs[0]
                runs.append(_Run(host, codes, mine))
            runs[-1].add(key, codes)
        yield _batch(out, _NAMES, _TYPES)
        out.clear()
    if runs:
        if len(runs) == 3:
            settle(*runs)
        elif len(runs) == 2:
            settle(None, runs[0], runs[1], False)
        settle(runs[-2] if len(runs) > 1 else None, runs[-1], None, True)
        yield _batch(out, _NAMES, _TYPES)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbours (part, last, before, after) of the outer runs of all ranges, in order; at most two a range."""
    runs = [r | {"mine": _open(r["codes"])} for batch in batches for r in batch.to_pylist()]
    near: dict[str, list] = {}
    for side, step, end in (("before", 1, "tail"), ("after", -1, "codes")):
        found: list = [None] * len(runs)
        for i in range(len(runs))[::step]:
            r, j = runs[i], i - step
            if r[side] is not None:
                found[i] = r[side]
            elif 0 <= j < len(runs) and runs[j]["host"] == r["host"]:
                found[i] = found[j] if runs[j]["mine"] == r["mine"] else runs[j][end]
        near[side] = found
    rows = [(r["part"], r["last"], b, a) for r, b, a in zip(runs, near["before"], near["after"], strict=True)]
    yield _batch(rows, ["part", "last", "before", "after"], [pa.int32(), pa.bool_(), _LONGS, _LONGS])


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, codes, before, after) of the outer runs in; what goes of each out."""
    for batch in batches:
        rows = [(key, *_differ(*x)) for key, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _batch(rows, ["key", "n_shared", "gone"], [pa.binary(), pa.int32(), pa.list_(pa.int32())])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_shared, n_gone): main text of every page.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by an empty line. Null, empty and text-free pages
    give an empty text. Every page is aligned with the page before and after by
    URL path within the host (see above); pages in a row of which marks
    leave in the same blocks have the same neighbours. n_blocks counts the blocks
    that marks leave in, n_shared those of them that a neighbour has too, n_gone
    those of these that went, as no mark says they are the article's. Equal paths are in order of their query and page_id, rows
    without a URL are neighbours of each other, pages without any text are
    nobody's; repeated rows repeat. Other columns of the input are not read; its
    rows are read twice and must be the same both times.
    """
    scratch = Scratch(pages.sparkSession)
    source = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    coded = scratch.keep(source.mapInArrow(tidy(_codes), "key binary, page_id long, url string, codes array<long>"))
    host, path, asked = [F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)([^#]*)", i) for i in (1, 2, 3)]
    placed = coded.where("size(codes) > 0").select("key", F.lower(host).alias("host"), path.alias("path"), asked.alias("asked"), "page_id", "codes")
    # ranges, so that a hot host is many tasks; what crosses their borders is settled afterwards
    ordered = placed.repartitionByRange("host", "path", "asked", "page_id").sortWithinPartitions("host", "path", "asked", "page_id", "codes")
    done = scratch.keep(ordered.select("key", "host", "codes").mapInArrow(tidy(_ranges), _UNIT))
    scratch.drop(coded)
    runs = done.where("key is null").select("part", "last", "host", "codes", "tail", "before", "after").repartition(1).sortWithinPartitions("part", "last")
    borders = scratch.keep(runs.mapInArrow(tidy(_borders), "part int, last boolean, before array<long>, after array<long>"))
    waiting = done.where("key is not null and part is not null").select("key", "part", "last", "codes").join(F.broadcast(borders), ["part", "last"])
    outer = waiting.select("key", "codes", "before", "after").mapInArrow(tidy(_outer), "key binary, n_shared int, gone array<int>")
    found = done.where("part is null").select("key", "n_shared", "gone").unionAll(outer)
    texts = source.mapInArrow(tidy(_texts), "key binary, page_id long, url string, blocks array<string>")
    none = F.array().cast("array<int>")
    # a row a page on either side: never a broadcast, however few the pages are
    whole = texts.join(found.hint("shuffle_hash"), "key", "left").withColumn("gone", F.coalesce("gone", none))
    text = F.array_join(F.filter("blocks", lambda _, i: ~F.array_contains("gone", i)), "\n\n")
    out = whole.select("page_id", "url", text.alias("text"), F.size("blocks").alias("n_blocks"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.size("gone").alias("n_gone"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), *[F.col(c).cast("long").alias(c) for c in ("n_blocks", "n_shared", "n_gone")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
