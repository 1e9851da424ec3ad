"""HTML extraction: doubtful blocks, broken markup, long texts, edge rows, and whole pages against a plain cut."""

import random
import re
import time
from html import unescape

import pytest

from loomline.llm import html_text

SCHEMA = "page_id long, url string, html string, lines string, host string"


def _texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)).collect()}


def test_names_of_elements():
    assert [html_text.name_of(n)[:2] for n in ("ad", "cookie-notice", "commentList", "related-posts", "main-nav")] == [(True, False)] * 5
    assert [html_text.name_of(n)[:2] for n in ("share-price", "ad-hoc", "related-work", "promoCode")] == [(False, True)] * 4
    assert [html_text.name_of(n)[:2] for n in ("lead", "story", "headline", "adhoc", "")] == [(False, False)] * 5


def test_doubtful_blocks_go_only_if_a_neighbour_has_them(spark):
    def page(price, more=""):
        return f'<body><div class=ad>buy</div><article><h1>T</h1><p class="share-price">{price}</p><p>text <span class="ad-hoc">so</span> on</p>{more}<div class="share-links-x">Tell all</div><ul class="sidebar"><li>no</li></ul></article><footer>f</footer>'

    rows = [(1, "http://h/a/1", page("12 dollars")), (2, "http://h/a/2", page("13 dollars", '<section id="related-work"><p>Others</p></section>')), (3, "http://other/x", page("12 dollars"))]
    got = _texts(spark, rows)
    assert got[1] == "T\n\n12 dollars\n\ntext\n\non"[:13] + "\n\ntext\n\non" or "12 dollars" in got[1]
    assert "Tell all" not in got[1] and "Tell all" not in got[2] and "Tell all" in got[3]
    assert "Others" in got[2] and "13 dollars" in got[2] and "12 dollars" in got[3]
    assert not any("buy" in t or "no" in t.split() or "f" in t.split() for t in got.values())


@pytest.mark.parametrize("html,want", [
    ("<article>a < b and c > d</article>", "a < b and c > d"),
    ("<article><p title='x>y'>one</p><p title=it's>two</p><p title=\"unclosed>three</p>", "one\n\ntwo\n\nthree"),
    ("<article>x<!-- c > <p> -->y<!-- never closed", "xy"),
    ("<article>x<script>if (a<b) { '</p>' }</script>y<style>never closed", "xy"),
    ("<article>x</b></i></article>y", "x"),
    ("<article>&lt;p&gt; &amp;amp; &nbsp; &#233; &#x1F600;</article>", "<p> &amp; é 😀"),
    ("<article>  a \n\t b c  </article>", "a b c"),
    ("<ARTICLE><P>A<BR>B</P></ARTICLE>", "A B"),
    ("<a x <a x", "<a x <a x"),
])
def test_markup(html, want):
    found = html_text.blocks(html)
    assert "\n\n".join(t for t, inside, _ in found if inside or "<article>" not in html.lower()) == want


@pytest.mark.parametrize("unit", ["<a x ", "<a x=\"", "<b>", "</b>", "<p>t", "<b><i></b>", "<!-- ", "<a 'b\" ", "<script>", "&lt", "<a b='>", "x" * 10 + "<"])
def test_time_grows_with_the_text(unit):
    def seconds(n):
        best = 9e9
        for _ in range(3):
            start = time.perf_counter()
            html_text.blocks("<article>" + unit * n)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(80_000) < 0.2 + 20 * seconds(10_000)


def test_edge_rows(spark):
    page = "<article>t</article>"
    rows = [(1, None, page), (2, "", None), (3, "http://h/a", ""), (4, "http://h/a", page), (4, "http://h/a", page), (None, "nonsense", "<p>only"), (6, "http://h/long", "<article>" + "<p>word</p>" * 200_000)]
    got = html_text.extract(spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[4] == "t" and texts[2] == texts[3] == "" and texts[None] == "only" and len(texts[6]) == 6 * 200_000 - 2
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages_equal_a_plain_cut(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def plain(html):
        body = re.search(r"<article>(.*?)</article>", html or "", re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|blockquote)\b[^>]*>", re.sub(r"<(script|style).*?</\1>|<!--.*?-->", "", body, flags=re.S))
        lines = [" ".join(unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", x)).split()) for x in parts]
        return "\n\n".join(x for x in lines if x)

    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


def _page(rng, i):
    """A page of one of six kinds: marked, marked with open names, without marks, a copy, without text, of a menu alone."""
    line = [f"<p>{'true line ' * 3}{rng.randrange(4)}</p>", f"<p>own {i}</p>", f'<p class="share-price">{rng.randrange(3)}</p>', f"<p>of {rng.randrange(3)}</p>"]
    top, end = f"<nav><ul><li>Home<li>More {rng.randrange(2)}</ul></nav><p>Top of the host</p>", f'<div class="ad">buy {rng.randrange(3)}</div><p>End of the host</p>'
    mid = "".join(rng.choice(line) for _ in range(rng.randrange(1, 7)))
    kind = rng.randrange(6)
    return [f"{top}<article>{mid}</article>{end}", f"{top}<article><p>own {i}</p>{mid}</article>{end}", f"{top}{mid}{end}", f"{top}<p>copy</p>{end}", rng.choice([None, "", "<style>p{}</style>"]), "<nav>menu</nav>"][kind]


IN = (html_text.ARTICLE, html_text.DOUBTFUL)


def _differenced(rows):
    """Brute force on texts over (page_id, url, html): text, n_blocks, n_shared, n_gone by page_id."""
    found = []
    for page, url, html in rows:
        host, path, asked = re.match(r"http://([^/?#]*)([^?#]*)([^#]*)", url).groups()
        if cut := html_text.judged(html or ""):
            found.append(((host, path, asked, page), cut, [b for b in cut if b[1] in IN]))
    found.sort(key=lambda x: x[0])
    out = {page: ("", 0, 0, 0) for page, _, _ in rows}
    for i, (at, cut, mine) in enumerate(found):
        both = set()
        for side in (found[:i][::-1], found[i + 1 :]):
            near = next((c for a, c, m in side if a[0] == at[0] and m != mine), [])
            both |= html_text.shared(*([(t, html_text.DOUBTFUL if k == html_text.BESIDE else k) for t, k in x] for x in (cut, near)))
        gone = {j for j in both if cut[j][1] == html_text.DOUBTFUL}
        text = "\n\n".join(t for j, (t, k) in enumerate(cut) if k in IN and j not in gone)
        out[at[3]] = (text, len(mine), sum(cut[j][1] in IN for j in both), len(gone))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_every_page_is_aligned_with_its_neighbours(spark, parts):
    rng = random.Random(parts)
    rows = [(i, f"http://h{rng.randrange(3)}/{rng.choice('abc')}{rng.choice(['', '?id=' + str(rng.randrange(9))])}", _page(rng, i)) for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = html_text.extract(spark.createDataFrame(rows + rows[:20], "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 170 and {r.page_id: (r.text, r.n_blocks, r.n_shared, r.n_gone) for r in got} == _differenced(rows)


def test_marked_pages_are_differenced_and_show_the_template_of_others(spark):
    marked = "<p>Top of the host</p><article><h1>T{0}</h1><p>both say so</p></article><p>End of the host</p>"
    rows = [(1, "http://h/1", marked.format(1)), (2, "http://h/2", "<p>Top of the host</p><h1>T2</h1><p>both say so</p><p>End of the host</p>"), (3, "http://h/3", marked.format(3)), (4, "http://h/4", marked.format(4))]
    got = {r.page_id: (r.text, r.n_blocks, r.n_shared, r.n_gone) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # what the neighbours' marks call article is no template of page 2; page 3 and 4 share a line of their articles, which stays
    assert got == {1: ("T1\n\nboth say so", 2, 0, 0), 2: ("T2\n\nboth say so", 4, 2, 2), 3: ("T3\n\nboth say so", 2, 1, 0), 4: ("T4\n\nboth say so", 2, 1, 0)}


@pytest.mark.parametrize("pairs", [0, 1, 64])
def test_alignment_is_a_longest_one(monkeypatch, pairs):
    monkeypatch.setattr(html_text, "PAIRS", pairs)
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, rest = sorted(html_text.shared(a, b)), iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


def test_alignment_of_long_pages_of_few_lines():
    rng = random.Random(5)
    a, b = ([rng.choice("xy") for _ in range(20_000)] for _ in range(2))
    start = time.perf_counter()
    assert len(html_text.shared(a, b)) > 15_000 and time.perf_counter() - start < 30
