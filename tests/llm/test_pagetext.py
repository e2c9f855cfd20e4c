import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperlens.llm import pagetext
from paperlens.operators import frames

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<div class="page with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav><!-- <p>no</p> -->
<article><header><h1>T &amp; U</h1><span>by me</span></header><p>a&nbsp;b<br>c<b>d</b><p class="ad">buy</p>Hello
<div class="cookie-notice">cookies</div><p>end <table><tr><td>1<td>2</table><section id="comments"><article class="comment">
<p>lol</p></article></section><form><p>mail</p></form><p>final &lt;p&gt; 1 < 2</article><aside>side</aside><footer>f</footer></div>"""


def test_structure():
    assert pagetext.main_blocks(pagetext.blocks(PAGE), None) == ["T & U", "a b cd", "Hello", "end", "1 2", "final <p> 1 < 2"]


@pytest.mark.parametrize("page,wanted", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>x</p><scr", ["x"]), ("<div class=menu>m</div><p>t", ["t"]),
    ("<p>1 < 2 &amp; 3</p>", ["1 < 2 & 3"]), ("<main><p>in</p></main><p>out</p>", ["in"]), ("<script>never closed", []),
    ('<div style="display: none">h</div><p hidden>h</p>t', ["t"]),
])
def test_small_pages(page, wanted):
    assert pagetext.main_blocks(pagetext.blocks(page), None) == wanted


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    wanted = {}
    for r in pages.collect():
        article = re.search("<article>(.*?)(</article>|$)", r["html"], re.DOTALL)[1]
        parts = [html.unescape(re.sub("<[^>]*>", " ", p)) for p in re.split("<p>|</p>|<h1>|</h1>", article)]
        wanted[r["page_id"]] = "\n\n".join(" ".join(p.split()) for p in parts if p.split())
    assert {r["page_id"]: r["text"] for r in pagetext.main_text(pages).collect()} == wanted


def brute_windows(streams):
    pages = defaultdict(set)
    for at, own in enumerate({tuple(s) for s in streams}):
        for i in range(len(own) - pagetext.WINDOW + 1):
            pages[own[i:i + pagetext.WINDOW]].add(at)
    return Counter({int(pagetext.window_hashes(np.array(w, np.uint16))[0]): len(p) for w, p in pages.items()})


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_counts_pages(seed):
    rng = random.Random(seed)
    passage = [rng.randint(0, 5) for _ in range(30)]
    streams = [[rng.randint(0, 3) for _ in range(rng.choice([0, 5, 8, 40]))] + passage[:rng.choice([0, 12, 30])] for _ in range(30)]
    hashes, pages = pagetext.shared_windows([np.array(s, np.uint16) for s in streams])
    assert dict(zip(hashes.tolist(), pages.tolist(), strict=True)) == dict(brute_windows(streams))


SHARED = "Our shop sends parcels to all countries on every day of the year"


def plain_pages(n):
    own = " ".join
    return [(i, f"http://shop.example.com/{i}", f"<body><div><p>{SHARED}</p></div><div><p>{own(f'word{i}x{j}' for j in range(20))}</p></div></body>")
            for i in range(n)]


@pytest.mark.parametrize("part_pages,sent", [(5_000, 200_000), (4, 200_000), (4, 0)])
def test_shared_blocks_go_and_unique_ones_stay(spark, monkeypatch, part_pages, sent):
    monkeypatch.setattr(pagetext, "PART_PAGES", part_pages)
    monkeypatch.setattr(frames.broadcast_if_small, "__defaults__", (sent, None))
    rows = plain_pages(12)
    rows += [(100, "http://other.example.com/", f"<p>{SHARED}</p>"), (101, "http://shop.example.com/copy", rows[0][2])]
    found = {r["page_id"]: r["text"] for r in pagetext.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == 14 and found[100] == SHARED
    assert all(SHARED not in found[i] and f"word{i}x19" in found[i] for i in range(12))
    assert found[101] == found[0]


NOTICE = "We may change these terms on any day without telling the readers of this site about it"


@pytest.mark.parametrize("part_pages", [1_000, 20])
def test_runs_that_most_pages_of_a_host_share_go_from_articles(spark, monkeypatch, part_pages):
    """A passage that some articles share is content, what a host puts on most of its pages is not."""
    monkeypatch.setattr(pagetext, "PART_PAGES", part_pages)

    def page(i, extra=""):
        return f"<article><h1>Title {i}</h1><p>{' '.join(f'w{i}x{j}' for j in range(15))}</p>{extra}<p>{NOTICE}</p></article>"

    rows = [(i, "http://a.example/x", page(i, f"<p>{SHARED}</p>" if i < 5 else "")) for i in range(50)]
    # On few pages of a host, or on a small share of them, nothing is put there by the host.
    rows += [(100 + i, "http://b.example/x", page(100 + i)) for i in range(5)]
    rows += [(200 + i, "http://c.example/x", page(200 + i) if i < 8 else page(200 + i).replace(NOTICE, f"end {i}")) for i in range(20)]
    rows += [(300 + i, "http://d.example/x", f"<article><p>{NOTICE}</p></article>") for i in range(9)]
    rows += [(400, "http://a.example/x", rows[0][2])] * 3
    found = {r["page_id"]: r["text"] for r in pagetext.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(NOTICE not in found[i] and f"w{i}x14" in found[i] and (SHARED in found[i]) == (i < 5) for i in range(50))
    assert all(NOTICE in found[100 + i] for i in range(5)) and all(NOTICE in found[200 + i] for i in range(8))
    assert all(found[300 + i] == NOTICE for i in range(9)) and found[400] == found[0]


@pytest.mark.parametrize("opened,closed", [
    ("<div class='post comments-open'><article>", "</article></div>"),
    ("<div id='content' class='with-navigation'><article>", "</article></div>"),
    ("<article class='post comment-status-open'>", "</article>"),
    ("<div class='comments'><article>", "</article></div>"),
])
def test_names_around_an_article_do_not_empty_the_page(opened, closed):
    assert pagetext.main_blocks(pagetext.blocks(f"<body>{opened}<p>The text.</p>{closed}</body>"), None) == ["The text."]


def test_comments_are_left_out_where_there_is_a_text():
    comments = "<div class='post-comments'><article class='comment'><p>First!</p></article></div>"
    for main in ("<article><p>The text.</p></article>", "<div><p>The text.</p></div>"):
        assert pagetext.main_blocks(pagetext.blocks(main + comments), None) == ["The text."]


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, host string, _page string"
    rows = [(1, None, None, "t", "h", "w"), (2, "x", "", "t", "h", "w"), (None, "http://a", "<p>p", None, None, None),
            (3, "http://a", "<p>p", "t", "h", "w"), (3, "http://a", "<p>p", "t", "h", "w"),
            (4, "http://a", "<p>" + "long text " * 100_000, None, None, None)]
    found = pagetext.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((len(r["text"]) for r in found)) == [0, 0, 1, 1, 1, 999_999]
    assert {r["host"] for r in found} == {"h", None}
    assert pagetext.main_text(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("part_pages, part_share", [(1_000, 0.25), (4, 0.25), (4, 0.5)])
def test_shares_in_articles_are_those_of_the_whole_host(spark, monkeypatch, part_pages, part_share):
    """Runs of all, just half and just under half of 24 pages, in one part or in six and more."""
    monkeypatch.setattr(pagetext, "PART_PAGES", part_pages)
    monkeypatch.setattr(pagetext, "PART_SHARE", part_share)
    said = [" ".join(f"{w}{k}" for k in range(10)) for w in ("all", "half", "fewer")]
    rows = []
    for i in range(24):
        own = " ".join(f"w{i}x{j}" for j in range(20))
        held = [said[0]] + ([said[1]] if i % 2 else []) + ([said[2]] if i < 11 else [])
        rows.append((i, "http://h/%d" % i, "<article>" + "".join(f"<p>{p}</p>" for p in [own, *held]) + "</article>"))
    texts = {r.page_id: r.text for r in pagetext.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(24):
        assert "all0" not in texts[i] and f"w{i}x0" in texts[i]
        assert "half0" not in texts[i]
        assert ("fewer0" in texts[i]) == (i < 11)
