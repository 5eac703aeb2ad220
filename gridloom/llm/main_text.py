"""Main text of web pages: structure of the markup, and a suffix array per host for text that pages repeat.

A page is read into blocks with a zone each: its article (or `main`, where it has no article), chrome (menus, headers,
footers, sidebars, notices, adverts, forms, comments, by element, role, class or id), and the rest. A page that declares
its article gives that article without the chrome in it, whatever other pages repeat of it: copied articles are text.

What a page shows besides is its stream: hashes of its words, with a mark at each border of a block. The streams of a
host are put one after the other, in blocks of bounded size; a suffix array of each block with its LCP table shows the
substrings of at least `least` tokens, and how many distinct streams hold each. Streams are dealt to the blocks of a
host by their content, so the counts of a host's blocks add up, and substrings that lie in several blocks are found
like those of one. Equal streams count as one. Where `pages` distinct ones hold a substring, its words are covered.
Pages that declare no article keep the unique runs: the words of the rest that nothing covers.

A host of any size is spread over its blocks. What is shuffled are streams without articles; page texts move once, to
meet what covers them, and a stream that many pages share is sent to them.

Defined results: null or empty html has the empty text. A page without a host name belongs to the host "". Null and
repeated ids pass through, one row per input row; an empty input gives an empty result. Unclosed or crossing elements
end with the element around them; an unclosed comment or script reaches to the end. White space is what Unicode calls
so, no-break blanks included. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.periodic_runs import suffix_array
from gridloom.llm.shared import cut, join_unique

#: Least length of a repeated substring in tokens (words and block borders), and the distinct streams that hold it.
LEAST, PAGES = 8, 3
#: Tokens of a host from which its streams are dealt into blocks of about this size.
BLOCK_TOKENS = 1 << 16
#: The token at the borders of blocks.
MARK = 0

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Elements by what they do to the text.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "meta", "link", "source", "track", "param", "embed"}
CHROME_ELEMENTS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Words of class names and ids; a name is split at hyphens and underscores.
CHROME_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar"}
CHROME_NAMES = {"header", "site-header", "page-header", "top-header", "site_header", "page_header"}
TELLS_OF_PARTS = ("has", "with", "without", "no", "is")
ARTICLE_CHROME = {"ad", "advert", "advertisement", "comment", "comments", "promo", "related", "sponsored"}
ARTICLE_NAMES = {"article-body", "article-content", "articlebody", "entry-content", "post-body", "post-content", "story-body"}

REST, MAIN, ARTICLE, CHROME = 0, 1, 2, 3


def _names(attributes: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        out.setdefault(name.lower(), []).extend(html.unescape("".join(values)).lower().split())
    return out


def zone_of(name: str, attributes: str, inside: int) -> int:
    """The zone that an element opens, or the one it stands in."""
    if inside == CHROME:
        return CHROME
    a = _names(attributes) if "=" in attributes else {}
    names = a.get("class", []) + a.get("id", [])
    if name in ("article", "main", "body", "html"):
        if any(re.split("[-_]", n)[0] in ARTICLE_CHROME for n in names):
            return CHROME if name == "article" else inside
        return max(inside, {"article": ARTICLE, "main": MAIN}.get(name, REST))
    if name in CHROME_ELEMENTS or name == "header" and not inside or CHROME_ROLES.intersection(a.get("role", ())):
        return CHROME
    for n in names:
        words = re.split("[-_]", n)
        if words[0] not in TELLS_OF_PARTS and CHROME_WORDS.intersection(words) or not inside and n in CHROME_NAMES:
            return CHROME
    if "articlebody" in a.get("itemprop", ()) or ARTICLE_NAMES.intersection(names):
        return ARTICLE
    return max(inside, MAIN) if "main" in a.get("role", ()) else inside


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page that have text."""
    out: list[tuple[int, str]] = []
    open_: list[tuple[str, int, int]] = []  # element, zone in it, zone around it
    zone, piece, at, m = REST, [], 0, TAG.search(page)

    def flush() -> None:
        if piece:
            if text := " ".join("".join(piece).split()):
                out.append((zone, text))
            piece.clear()

    while m:
        if m.start() > at:
            piece.append(html.unescape(page[at : m.start()]))
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            pass  # a comment or declaration
        elif m[1]:
            if name not in INLINE:
                flush()
            k = next((k for k in reversed(range(len(open_))) if open_[k][0] == name), None)
            if k is not None:
                if open_[k][2] != zone:
                    flush()
                    zone = open_[k][2]
                del open_[k:]
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            piece.append(" ")
        else:
            if name == "br" or name not in INLINE:
                flush() if name != "br" else piece.append(" ")
                if open_ and open_[-1][0] in ("p", "li", "option") and (open_[-1][0] == "p" or open_[-1][0] == name):
                    zone = open_.pop()[2]
            if name not in VOID and not m[3].endswith("/"):
                new = zone_of(name, m[3], zone)
                if zone == CHROME and name in ("article", "main") and {x[0] for x in open_ if x[1] == CHROME != x[2]} == {"form"}:
                    new = zone_of(name, m[3], REST)  # a form around the whole page
                if new != zone:
                    flush()
                if new != zone or name not in INLINE:
                    open_.append((name, new, zone))
                zone = new
        m = TAG.search(page, at)
    piece.append(html.unescape(page[at:]))
    flush()
    return out


def read_page(page: str | None) -> tuple[str | None, list[str], list[int], list[int]]:
    """Text of the declared article (None where there is none), blocks of the rest of a page without one, where each
    starts in the stream, and the stream."""
    blocks = blocks_of(page or "")
    level = max((z for z, _ in blocks if z != CHROME), default=REST)
    stream, rest, starts = [], [], []
    for z, text in blocks:
        if level and z == level:
            continue
        stream.append(MARK)
        if not level and z == REST:
            rest.append(text)
            starts.append(len(stream))
        stream += [xxhash.xxh64_intdigest(w.encode()) >> 1 | 1 for w in text.split(" ")]
    if stream:
        stream.append(MARK)
    return " ".join(t for z, t in blocks if z == level) if level else None, rest, starts, stream


PARSED = "page_id long, url string, host string, text string, rest array<string>, starts array<int>, stream array<long>"


def parsed(pages: DataFrame) -> DataFrame:
    def read(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        columns, held = [[] for _ in kinds], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PARSED.split(", ")])
        for b in batches:
            for k in range(b.num_rows):
                page = b.column(3)[k].as_py()
                for c, value in zip(columns, (*(b.column(j)[k].as_py() for j in range(3)), *read_page(page))):
                    c.append(value)
                held += len(page or "")
                if held > 4 << 20:
                    yield whole()
                    columns, held = [[] for _ in kinds], 0
        if columns[0]:
            yield whole()

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), "html").mapInArrow(read, PARSED)


def substrings(streams: list[np.ndarray], least: int, often: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(digest, distinct streams, places) of each class of equal substrings of `least` tokens: the LCP intervals of that
    depth, as runs of the suffix array, that stand `often` times. places: (stream, position) rows."""
    codes = np.unique(np.concatenate(streams), return_inverse=True)[1] if streams else np.zeros(0, int)
    joined, owner, position, at = [], [], [], 0
    for k, s in enumerate(streams):
        joined += [codes[at : at + len(s)], [-1 - k]]  # each border stands once
        owner.append(np.full(len(s) + 1, k))
        position.append(np.arange(len(s) + 1))
        at += len(s)
    x, owner, position = (np.concatenate(v) for v in (joined, owner, position))
    order, _, lcp = suffix_array(x)
    begins = np.flatnonzero(lcp < least)
    ends = np.append(begins[1:], len(order))
    for lo, hi in zip(begins[ends - begins >= often], ends[ends - begins >= often]):
        at = order[lo:hi]
        k, p = owner[at], position[at]
        if p[0] + least <= len(streams[k[0]]):
            digest = xxhash.xxh64_intdigest(np.ascontiguousarray(streams[k[0]][p[0] : p[0] + least]).tobytes())
            yield digest - (1 << 64 if digest >> 63 else 0), np.unique(k), np.stack([k, p], 1)


def ranges_of(length: int, starts: np.ndarray, least: int) -> list[int]:
    """From, to, from, to, ... of what substrings at the starts cover."""
    held = np.zeros(length + 1, np.int8)
    for s in starts:
        held[s : s + least] = 1
    return np.flatnonzero(np.diff(held, prepend=0)).tolist()


COVERED = "host string, s1 long, s2 long, n long, covered array<int>"


def covered(streams: DataFrame, least: int, pages: int) -> DataFrame:
    """What covers each stream. streams: host, s1, s2, n, stream, blocks, block."""

    def arrays(table: pa.Table) -> list[np.ndarray]:
        return [np.array(s, np.int64) for s in table.column("stream").to_pylist()]

    def rows(table: pa.Table, own: list[np.ndarray], places: list[np.ndarray]) -> pa.Table:
        at: list[list[int]] = [[] for _ in own]
        for k, p in (row for place in places for row in place.tolist()):
            at[k].append(p)
        found = [ranges_of(len(s), np.array(a, int), least) for s, a in zip(own, at)]
        return pa.Table.from_arrays([*(table.column(c) for c in ("host", "s1", "s2", "n")), pa.array(found, pa.list_(pa.int32()))], ["host", "s1", "s2", "n", "covered"])

    def alone(table: pa.Table) -> pa.Table:
        own = arrays(table)
        return rows(table, own, [at for _, held, at in substrings(own, least, pages) if len(held) >= pages])

    def counted(table: pa.Table) -> pa.Table:
        found = [(digest, len(held)) for digest, held, _ in substrings(arrays(table), least)]
        first = lambda c, kind: pa.array([table.column(c)[0].as_py()] * len(found), kind)
        return pa.Table.from_arrays([first("host", pa.string()), first("block", pa.int64()), pa.array([d for d, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["host", "block", "digest", "held"])

    def marked(table: pa.Table, repeated: pa.Table) -> pa.Table:
        own, known = arrays(table), set(repeated.column("digest").to_pylist())
        return rows(table, own, [at for digest, _, at in substrings(own, least) if digest in known] if known and own else [])

    one = streams.filter("blocks = 1").groupBy("host").applyInArrow(alone, COVERED)
    large = streams.filter("blocks > 1")
    counts = cut(large.groupBy("host", "block").applyInArrow(counted, "host string, block long, digest long, held long"), "main-text-counts")
    repeated = counts.groupBy("host", "digest").agg(F.sum("held").alias("held")).filter(F.col("held") >= pages)
    known = counts.join(repeated.select("host", "digest"), ["host", "digest"], "left_semi").select("host", "block", "digest")
    many = large.groupBy("host", "block").cogroup(known.groupBy("host", "block")).applyInArrow(marked, COVERED)
    return one.unionByName(many)


def extract(pages: DataFrame, least: int = LEAST, min_pages: int = PAGES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, declared (an article or main element gives the text), n_covered (words and borders
    outside the article that other pages repeat)."""
    read = cut(parsed(pages).withColumns({"s1": F.xxhash64("stream"), "s2": F.xxhash64(F.lit(1), "stream")}), "main-text-pages")
    distinct = read.groupBy("host", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.first("stream").alias("stream"))
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n_streams"), F.ceil(F.sum(F.size("stream")) / block_tokens).cast("long").alias("blocks"))
    distinct, sizes = cut(distinct, "main-text-streams"), cut(sizes.withColumn("blocks", F.greatest("blocks", F.lit(1))), "main-text-hosts")
    streams = join_unique(distinct, sizes, ["host"], "n_streams", distinct.count()).withColumn("block", F.pmod("s1", "blocks"))
    found = cut(covered(streams.select("host", "s1", "s2", "n", "stream", "blocks", "block"), least, min_pages), "main-text-covered")

    def assemble(batches):
        for b in batches:
            texts, n = b.column(2).to_pylist(), []
            for k, ranges in enumerate(b.column(5).to_pylist()):
                n.append(sum(ranges[1::2]) - sum(ranges[::2]))
                if texts[k] is None:
                    gone = np.zeros(max([0, *ranges]) + 1, bool)
                    for lo, hi in zip(ranges[::2], ranges[1::2]):
                        gone[lo:hi] = True
                    kept = []
                    for start, text in zip(b.column(4)[k].as_py(), b.column(3)[k].as_py()):
                        kept += [w for i, w in enumerate(text.split(" "), start) if i >= len(gone) or not gone[i]]
                    texts[k] = " ".join(kept)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(2).is_valid(), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_chars", "declared", "n_covered"])

    met = join_unique(read, found, ["host", "s1", "s2"], "n", read.count())
    return met.select("page_id", "url", "text", "rest", "starts", "covered").mapInArrow(assemble, "page_id long, url string, text string, n_chars long, declared boolean, n_covered long")
