"""Main text of web pages: structure, and substrings that pages of a host share.

A page is cut into blocks. Blocks of scripts, menus, forms and the like go by their markup. What is
boilerplate among the others is told by the token streams of pages: the streams of a host's
pages are concatenated, their suffixes are sorted, and runs of ``WINDOW`` tokens or more are found that
several distinct pages share; blocks that such runs cover go, unique runs stay. On pages with an ``article`` or
``main`` element, where pages may quote each other, a run must be on ``ARTICLE_PAGES`` pages and on
``ARTICLE_SHARE`` of all of the host, as only what a host puts on its pages is. On other pages runs
count that ``PAGES`` pages share in blocks outside articles.

A host with many pages is sorted in parts, dealt by hash. The parts pass on how many pages hold a run of ``WINDOW``
tokens (for the first rule only runs that many of their pages hold), and learn which ones the sums make shared. So no host, and no list of its runs, has to fit into one task.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlens.llm.arrow import map_texts
from paperlens.operators.frames import broadcast_if_small, has_at_most, lookup_join
from paperlens.session import checkpointed

WINDOW, PAGES, COVERED = 8, 3, 0.8
ARTICLE_PAGES, ARTICLE_SHARE = 6, 0.5
# Pages of a host that are sorted together, and the share of them that makes such a part pass a window on.
PART_PAGES, PART_SHARE = 1_000, 0.25

# Elements by their role in a page.
_RAW = "script|style|title|noscript|template|iframe|object|svg|math|textarea|select|button|canvas|audio|video"
_DROPPED = frozenset("nav footer aside form dialog menu header fieldset".split())
_CONTAINERS = frozenset(
    "html head body main article section div nav header footer aside form dialog menu fieldset ul ol dl table "
    "figure details blockquote center".split())
_BLOCKS = _CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd tr thead tbody tfoot caption figcaption pre address hr summary legend".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
# Words in class and id that mark boilerplate; those of the second list even around an article.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert newsletter subscribe subscription signup paywall popup modal overlay "
    "sidebar widget toolbar share sharing social masthead topbar header login search copyright skip".split())
_STRONG = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer related recommended comment comments "
    "commentlist disqus reply replies respond".split())

# A class of these and a strong word tells a state of what it is on, not what it is.
_STATES = frozenset("with has no is without show hide".split())

_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")

# Where a block stands; a wrapped one is in an article inside something that is boilerplate by its name.
ARTICLE, OUTSIDE, DROPPED, WRAPPED = 0, 1, 2, 3


def _hints(attributes: str) -> tuple[bool, bool]:
    """Whether attributes mark boilerplate, and whether so strongly that an article inside is none: by a class or
    id that ends in a strong word (``post-comments``, not ``comments-open`` or ``with-navigation``)."""
    weak = strong = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for words in map(_WORD.findall, value.split()):
                weak = weak or not _HINTS.isdisjoint(words) or not _STRONG.isdisjoint(words)
                strong = strong or (bool(words) and words[-1] in _STRONG and words[0] not in _STATES)
        elif name == "role":
            strong = strong or value in _ROLES
        elif (name == "style" and "display:none" in value.replace(" ", "")) or name == "hidden" or (
                name == "aria-hidden" and value == "true"):
            strong = True
    return weak or strong, strong


def blocks(page: str) -> list[tuple[int, str]]:
    """(place, text) of the blocks of a page, in page order, without white space at their ends."""
    found: list[tuple[int, str]] = []
    # Open containers: name, dropped, dropped whatever comes, inside an article, in a header.
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]
    text: list[str] = []
    leaf_dropped = heading = False

    def close() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                _, dropped, never, article, header = stack[-1]
                out = dropped or leaf_dropped or (header and not heading)
                place = DROPPED if out or (never and not article) else WRAPPED if never else ARTICLE if article else OUTSIDE
                found.append((place, joined))
            text.clear()

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name not in _BLOCKS:
            if name in ("td", "th"):
                text.append(" ")
            continue
        close()
        leaf_dropped = heading = False
        if m[2]:
            if name in _CONTAINERS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
            continue
        weak, strong = _hints(m[4]) if m[4].strip() else (False, False)
        if name not in _CONTAINERS:
            leaf_dropped, heading = weak, name in _HEADINGS
            continue
        _, dropped, never, article, header = stack[-1]
        if name in ("article", "main"):
            never = never or strong
            stack.append((name, False, never, True, False))
        elif name in ("html", "body"):
            stack.append((name, dropped, never, article, header))
        elif article and (name == "header" or (weak and not strong and "header" in m[4].lower())):
            stack.append((name, dropped, never, article, True))
        else:
            stack.append((name, dropped or weak or name in _DROPPED, never or strong or (
                name in _DROPPED and name not in ("header", "form")), article, header))
    if at < len(page):
        rest = page[at:]
        # A tag that the page's end cut off is no text.
        cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)
        text.append(rest[:cut.start()] if cut else rest)
    close()
    return found


def tokens(text: str) -> list[int]:
    """16 bits of each word: eight in a row are 128 bits, so windows are told apart."""
    return [zlib.crc32(w.encode()) & 0xFFFF for w in text.split()]


def stream(parts: list[tuple[int, str]], outside: bool = False) -> np.ndarray:
    """Tokens of all blocks, or of those outside articles."""
    return np.array([t for place, text in parts if not outside or place not in (ARTICLE, WRAPPED) for t in tokens(text)], np.uint16)


def window_hashes(values: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` tokens at each place that has so many."""
    count = max(0, len(values) - WINDOW + 1)
    out = np.zeros(count, np.uint64)
    wide = values.astype(np.uint64)
    for at in range(WINDOW):
        out = (out ^ wide[at:at + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shared_windows(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a host's streams and in how many different streams each occurs, from a suffix array.

    Suffixes are sorted by their first ``WINDOW`` tokens; those that agree in them are neighbours.
    """
    streams = list({s.tobytes(): s for s in streams}.values())
    long = [s for s in streams if len(s) >= WINDOW]
    if not long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.concatenate(long)
    lengths = np.array([len(s) for s in long])
    owner = np.repeat(np.arange(len(long)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    suffixes = np.flatnonzero(np.arange(len(joined)) + WINDOW <= ends)
    # Four tokens make a key of the sort.
    count, step = len(joined) - 3, 4
    keys = np.zeros(max(0, count), np.uint64)
    for at in range(step):
        keys = keys << np.uint64(16) | joined[at:at + count]
    order = suffixes[np.lexsort([owner[suffixes], *[keys[suffixes + at] for at in range(WINDOW - step, -1, -step)]])]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for at in range(0, WINDOW, step):
        own = keys[order + at]
        new[1:] |= own[1:] != own[:-1]
    new_page = new.copy()
    new_page[1:] |= owner[order][1:] != owner[order][:-1]
    starts = np.flatnonzero(new)
    pages = np.add.reduceat(new_page.astype(np.int64), starts)
    return window_hashes(joined)[order[starts]], pages


def cover(values: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which tokens of a stream shared runs cover; ``shared``: sorted hashes of the windows that pages share."""
    covered = np.zeros(len(values), bool)
    hashes = window_hashes(values)
    if len(shared) and len(hashes):
        at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
        for start in np.flatnonzero(shared[at] == hashes):
            covered[start:start + WINDOW] = True
    return covered


def main_blocks(parts: list[tuple[int, str]], covered: np.ndarray | None) -> list[str]:
    """The blocks that are kept; ``covered``: what ``cover`` says of the page's stream, if anything is shared."""
    kept: dict[int, list[str]] = {ARTICLE: [], OUTSIDE: [], WRAPPED: []}
    every: dict[int, list[str]] = {ARTICLE: [], OUTSIDE: [], WRAPPED: []}
    start = 0
    for place, text in parts:
        size = len(text.split())
        own = covered[start:start + size] if covered is not None else np.zeros(0)
        start += size
        if place == DROPPED:
            continue
        every[place].append(text)
        if not len(own) or own.mean() < COVERED:
            kept[place].append(text)
    # A page that its host repeats as a whole has no unique run; its blocks are its text then. What stands in an
    # article inside boilerplate, such as a reader's comment, is the text of a page that has no other.
    for place in (ARTICLE, OUTSIDE, WRAPPED):
        if every[place]:
            return kept[place] or every[place]
    return []


def host(url: Column) -> Column:
    """Host of a url in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _stream_of(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint16)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each group; they stand together."""
    group, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*key, *values]), strict=True):
            if row[:len(key)] != group:
                if held:
                    yield group, held
                group, held = row[:len(key)], []
            held.append(row[len(key):])
    if held:
        yield group, held


_COVERED = "host string, digest binary, _covered binary"


def _covered_batch(name: str, rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(rows), pa.string()), *[pa.array([r[at] for r in rows], pa.binary()) for at in (0, 1)]],
        ["host", "digest", "_covered"])


def covered_articles(streams: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, digest, _covered): of pages with an article what runs cover that most pages of their host share.

    A host of several parts sums the counts of its parts. A part passes on windows that ``PART_SHARE`` of its pages hold;
    what half of all pages share is among them in some part. Where the parts that did not name a window could decide
    on it, they count it, too.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _), held in _groups(batches, ["host", "part"], ["digest", "tokens", "open"]):
            pages = {digest: (_stream_of(data), open_) for digest, data, open_ in held}
            hashes, counts = shared_windows([own for own, _ in pages.values()])
            wide = np.sort(hashes[(counts >= ARTICLE_PAGES) & (counts >= ARTICLE_SHARE * len(pages))])
            marks = [(digest, cover(own, wide)) for digest, (own, open_) in pages.items() if len(wide) and not open_]
            yield _covered_batch(name, [(digest, _packed(own)) for digest, own in marks if own.any()])

    known = checkpointed(sizes.where(F.col("pages") >= ARTICLE_PAGES).select("host", "parts", "pages"))
    dealt = lookup_join(
        streams.where("tokens is not null").select("host", "digest", "tokens", "open"), known, "host", row_bytes=200
    ).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    whole = (
        dealt.where("parts = 1").select("host", "part", "digest", "tokens", "open").repartition("host", "part")
        .sortWithinPartitions("host", "part").mapInArrow(work, _COVERED)
    )
    if has_at_most(known.where("parts > 1"), 0):
        return whole
    split = dealt.where("parts > 1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, _), held in _groups(batches, ["host", "part"], ["digest", "tokens"]):
            pages = dict(held)
            hashes, counts = shared_windows([_stream_of(data) for data in pages.values()])
            some = counts >= PART_SHARE * len(pages)
            rows = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * rows, pa.string()), pa.array(hashes[some]), pa.array(counts[some], pa.int64()),
                 pa.array([len(pages)] * rows, pa.int64())], ["host", "window", "n", "held"])

    counted = split.select("host", "part", "digest", "tokens").repartition("host", "part").sortWithinPartitions(
        "host", "part").mapInArrow(count, "host string, window long, n long, held long")
    sums = checkpointed(counted.groupBy("host", "window").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).join(known, "host"))
    wanted = F.greatest(F.lit(float(ARTICLE_PAGES)), ARTICLE_SHARE * F.col("pages"))
    at_most = F.col("n") + PART_SHARE * (F.col("pages") - F.col("held"))
    shared = sums.where(F.col("n") >= wanted).select("host", "window")
    unsure = sums.where((F.col("n") < wanted) & (at_most >= wanted)).select("host", "window")

    def met(windows: DataFrame):
        """Parts of the hosts of ``windows`` with these."""
        told = windows.join(known.select("host", "parts"), "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = lookup_join(split.select("host", "part", "digest", "tokens", "open"), windows.select("host").distinct(), "host")
        return rows.groupBy("host", "part").cogroup(told.select("host", "part", "window").groupBy("host", "part"))

    def recount(left: pa.Table, right: pa.Table) -> pa.Table:
        pages = dict(zip(left["digest"].to_pylist(), left["tokens"].to_pylist(), strict=True))
        hashes, counts = shared_windows([_stream_of(data) for data in pages.values()])
        some = np.isin(hashes, right["window"].to_numpy())
        name = left["host"][0].as_py() if left.num_rows else None
        return pa.table([pa.array([name] * int(some.sum()), pa.string()), pa.array(hashes[some]), pa.array(counts[some], pa.int64())],
                        names=["host", "window", "n"])

    def covers(left: pa.Table, right: pa.Table) -> pa.Table:
        windows = np.sort(right["window"].to_numpy())
        pages = {digest: data for digest, data, open_ in zip(*(left[c].to_pylist() for c in ("digest", "tokens", "open"))) if not open_}
        marks = [(digest, cover(_stream_of(data), windows)) for digest, data in pages.items()]
        name = left["host"][0].as_py() if left.num_rows else None
        return pa.Table.from_batches([_covered_batch(name, [(digest, _packed(own)) for digest, own in marks if own.any()])])

    if not has_at_most(unsure, 0):
        again = met(unsure).applyInArrow(recount, "host string, window long, n long")
        shared = shared.unionByName(again.groupBy("host", "window").agg(F.sum("n").alias("n")).join(known, "host").where(
            F.col("n") >= wanted).select("host", "window"))
    return whole.unionByName(met(checkpointed(shared)).applyInArrow(covers, _COVERED))


def covered_open_pages(streams: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, digest, _covered): of pages without an article what runs cover that pages of the host share outside articles."""
    hosts = sizes.where((F.col("pages") >= PAGES) & (F.col("open_pages") > 0)).select("host", "parts")
    outside = lookup_join(streams.where("outside is not null").select("host", "digest", "outside", "open"), hosts, "host", row_bytes=200)
    dealt = checkpointed(outside.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, part, parts), held in _groups(batches, ["host", "part", "parts"], ["outside"]):
            hashes, pages = shared_windows([_stream_of(data) for (data,) in held])
            # A host of one part needs no sums, so only shared windows leave the task.
            some = pages >= (PAGES if parts == 1 else 1)
            rows = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * rows, pa.string()), pa.array([part] * rows, pa.int32()), pa.array(hashes[some]), pa.array(pages[some])],
                ["host", "part", "window", "n"])

    counted = checkpointed(
        dealt.select("host", "part", "parts", "outside").repartition("host", "part").sortWithinPartitions("host", "part")
        .mapInArrow(count, "host string, part int, window long, n long")
    )
    shared = counted.groupBy("host", "window").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES).select("host", "window")
    # A part learns of the windows that it holds itself.
    learnt = counted.select("host", "part", "window").join(shared, ["host", "window"])

    def covers(left: pa.Table, right: pa.Table) -> pa.Table:
        windows = np.sort(right["window"].to_numpy())
        streams_ = dict(zip(left["digest"].to_pylist(), left["outside"].to_pylist(), strict=True))
        marks = [(digest, cover(_stream_of(data), windows)) for digest, data in streams_.items()]
        name = left["host"][0].as_py() if left.num_rows else None
        return pa.Table.from_batches([_covered_batch(name, [(digest, _packed(own)) for digest, own in marks if own.any()])])

    return dealt.where("open").select("host", "part", "digest", "outside").groupBy("host", "part").cogroup(
        learnt.groupBy("host", "part")).applyInArrow(covers, _COVERED)


def covered_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(_host, _page, _covered): of the pages that hold shared runs, by the digest of their html, which tokens
    these cover, packed."""
    seen: set[tuple[str, bytes]] = set()

    def parsed(texts: list[str], hosts: list[str]) -> list[list]:
        rows = []
        for text, name in zip(texts, hosts, strict=True):
            parts = blocks(text)
            whole, open_ = stream(parts), all(place != ARTICLE for place, _ in parts)
            digest = hashlib.blake2b(whole.tobytes() + bytes([open_]), digest_size=16).digest()
            # A task passes on a stream once, so copies of a page do not pile up.
            first = (name, digest) not in seen
            seen.add((name, digest))
            outside = stream(parts, outside=True)
            rows.append((digest, open_, len(whole) >= WINDOW, _packed(whole) if first and len(whole) >= WINDOW else None,
                         _packed(outside) if first and len(outside) >= WINDOW else None))
        return list(map(list, zip(*rows))) or [[]] * 5

    added = {"digest": pa.binary(), "open": pa.bool_(), "long": pa.bool_(), "tokens": pa.binary(), "outside": pa.binary()}
    streams = checkpointed(map_texts(
        pages.select(host(F.col(f"`{url}`")).alias("host"), F.md5(F.col(f"`{html}`").cast("binary")).alias("page"),
                     F.col(f"`{html}`").alias("_html")), "_html", added,
        "digest binary, open boolean, long boolean, tokens binary, outside binary", parsed, also="host"))
    # Equal streams count once.
    different = streams.where("long").select("host", "digest", "open").distinct()
    sizes = checkpointed(different.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum(F.col("open").cast("int")).alias("open_pages"),
        F.ceil(F.count("*") / PART_PAGES).cast("int").alias("parts")))
    found = covered_articles(streams, sizes).unionByName(covered_open_pages(streams, sizes))
    return streams.where("long").select("host", "digest", "page").distinct().join(found, ["host", "digest"]).select(
        F.col("host").alias("_host"), F.col("page").alias("_page"), "_covered")


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text``: the kept blocks, joined by an empty line.

    Character references are decoded, white space in a block becomes one space. A null or empty page has the
    empty text; a null url is a host of its own. Rows are kept one by one; a column named text is
    replaced.
    """
    names = [c for c in pages.columns if c not in (html, "text")]
    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                         host(F.col(f"`{url}`")).alias("_host"), F.col(f"`{html}`").alias("_html"))
    covered = checkpointed(covered_pages(pages, url, html))
    marked = plain.withColumn("_page", F.md5(F.col("_html").cast("binary"))).join(
        broadcast_if_small(covered), ["_host", "_page"], "left")

    def work(texts: list[str], marks: list) -> list[list]:
        return [["\n\n".join(main_blocks(blocks(page), np.frombuffer(zlib.decompress(own), bool) if own else None))
                 for page, own in zip(texts, marks, strict=True)]]

    kept = [f"c{i}" for i in range(len(names))]
    return map_texts(
        marked.select(*kept, "_html", "_covered"), "_html", {"text": pa.string()}, "text string", work, also="_covered",
    ).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "text")
