"""Main text of web pages: nearest-URL page differencing, with the page's own structure as a guard.

Pages are ordered by host and URL path.  Each page is cut into text lines, one per block, and compared with the page
whose path is nearest to its own: lines that stand in both, in the same order (longest common subsequence), are
template and go.  A neighbour that shares all lines, or half of the long ones or more, is a copy of the page rather than
a page of the same template, and the next nearest is taken.  So short lines, as menus have, may well be most of a page.

Differencing alone gives wrong results on two sides, so structure decides first: menus, adverts and footers can be
worded anew on every page, and passages of an article can stand in its neighbour.  Elements whose name, role, class
or id marks them as no article are left out (class and id do not count on html, body, article and main, nor on
elements around the page's longest marked article, whose classes tell of the layout); where a page marks its article (``article``, ``main``), the article's
lines are the text and none of them is taken for template.  Lines of pages without such a mark are settled by
differencing.

Scale: pages are range-partitioned by (host, path, id), so a host with a third of all pages is spread over many
tasks; neighbours are sought within a partition, in order, with five pages in memory.

Defined cases: null html and pages without text give an empty text; a null url counts as one host with an empty
path; equal urls are ordered by id; a page alone in its host loses no line to differencing.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/><\"']*)|[!?])")
SPECIAL = re.compile("[>\"']")
#: Characters of a line that is more likely prose than a menu entry.
LONG = 80
#: No ``>`` comes any more.
NONE = -1
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
OUTSIDE = {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "menu", "dialog", "svg", "canvas",
    "object", "audio", "video", "map", "datalist",
} | RAW
BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5",
    "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "thead", "tfoot", "caption", "tr", "ul", "header",
    "footer", "nav", "aside", "form", "fieldset",
}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open one of these ends where the named element starts.
ENDS = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
STRONG = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "comment", "comments", "disqus", "replies",
    "cookie", "cookies", "consent", "gdpr", "newsletter", "popup", "modal", "breadcrumb", "breadcrumbs", "sidebar", "navbar", "menu", "nav",
}
WEAK = {"header", "footer", "masthead", "banner", "notice", "notices", "alert", "aside", "share", "sharing", "social", "related", "pagination", "pager",
        "widget", "toolbar", "subscribe", "signup", "login", "search", "copyright", "skip", "navigation", "topbar", "form"}
CONTENT = {"article", "post", "entry", "story", "content", "main"}
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


class Tag(NamedTuple):
    """A tag, or a comment with an empty name."""

    start: int
    end: int
    closes: bool
    name: str
    attributes: str


def next_tag(page: str, at: int, dead: set[int]) -> Tag | None:
    """The first whole tag or comment from ``at`` on; a tag ends at a ``>`` outside quotes, and one that never ends is text.

    ``dead`` keeps the quotes from which no tag ends, for later calls on the same page; so a page is read in linear time
    whatever its quotes.
    """
    while m := OPENING.search(page, at):
        if m[2] is None:
            if (page.startswith("<!--", m.start()) or NONE not in dead) and (c := COMMENT.match(page, m.start())):
                return Tag(m.start(), c.end(), False, "", "")
            dead.add(NONE)
        elif NONE not in dead:
            seen, pos = [], m.end()
            while (s := SPECIAL.search(page, pos)) and s.start() not in dead:
                if s[0] == ">":
                    return Tag(m.start(), s.end(), bool(m[1]), m[2].lower(), page[m.end() : s.start()])
                seen.append(s.start())
                close = page.find(s[0], s.end())
                if close < 0:
                    break
                pos = close + 1
            dead.update(seen)
            if s is None and not seen:
                dead.add(NONE)
        at = m.start() + 1
    return None


def is_outside(name: str, attributes: str, in_article: bool, around_article: bool = False) -> bool:
    """Whether an element is no part of an article, by its name, role, class or id; class and id say nothing of one ``around_article``."""
    if name in OUTSIDE and not (name == "header" and in_article):
        return True
    if not attributes:
        return False
    marks = set()
    for key, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        key = key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            marks.update(w.lower() for w in WORDS.findall(value))
    if around_article or name in ("body", "html", "article", "main"):
        return False
    return bool(marks & STRONG) or bool(marks & WEAK and not marks & CONTENT)


def around_article(page: str) -> set[int]:
    """Where the tags of the elements stand that the page's longest marked article lies in.

    Comments and teasers can be articles too, so an article that is less than half of its ``main`` does not count.  Without
    an article that counts, the longest ``main`` takes its place.
    """
    stack: list[tuple[str, int, bool]] = []  # name, place, outside by name or role
    articles: list[tuple[int, set[int], int]] = []  # length, places around it, place of its main or -1
    mains: dict[int, int] = {}
    around: dict[int, set[int]] = {}

    def close(end: int) -> str:
        name, start, out = stack.pop()
        if name == "main" and not out:
            mains[start] = end - start
            around[start] = {s[1] for s in stack}
        if name == "article" and not out and not any(s[0] == name for s in stack):
            articles.append((end - start, {s[1] for s in stack}, next((s[1] for s in stack if s[0] == "main"), -1)))
        return name

    at, dead = 0, set()
    while m := next_tag(page, at, dead):
        at = m.end
        name = m.name
        if not name or name in VOID:
            continue
        if m.closes:
            if any(s[0] == name for s in stack):
                while close(at) != name:
                    pass
            continue
        if name in RAW:
            closing = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            continue
        while stack and name in ENDS.get(stack[-1][0], ()):
            close(m.start)
        if m.attributes.endswith("/") and name not in BLOCK:
            continue
        stack.append((name, m.start, bool(stack and stack[-1][2]) or is_outside(name, m.attributes, False, True)))
    while stack:
        close(len(page))
    whole = [a for a in articles if 2 * a[0] >= mains.get(a[2], 0)]
    return max(whole, key=lambda a: a[0], default=(0, around[max(mains, key=mains.get)] if mains else set()))[1]


def page_lines(page: str) -> tuple[list[str], list[bool]]:
    """The lines of a page outside its menus and the like, and which of them lie in a marked article."""
    lines: list[str] = []
    marked: list[bool] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, outside, in article, in a header of the article
    outside = article = header = False

    def close_line() -> None:
        if parts:
            line = " ".join("".join(parts).split())
            parts.clear()
            if line:
                lines.append(line)
                marked.append(article)

    def text(raw: str) -> None:
        if raw and not outside and (not header or any(s[0] in HEADING for s in stack)):
            parts.append(html.unescape(raw))

    around = around_article(page)
    at, end, dead = 0, len(page), set()
    while at < end:
        m = next_tag(page, at, dead)
        text(page[at : m.start if m else end])
        if not m:
            break
        at = m.end
        name = m.name
        if not name:
            continue
        if m.closes:
            if any(s[0] == name for s in stack):
                if name in BLOCK:
                    close_line()
                while stack:
                    gone = stack.pop()
                    if gone[0] == name:
                        break
                _, outside, article, header = stack[-1] if stack else ("", False, False, False)
            elif name in BLOCK:
                close_line()
            continue
        if name == "br":
            text(" ")
        if name in BLOCK:
            close_line()
        if name in VOID:
            continue
        if name in RAW:
            closing = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        while stack and name in ENDS.get(stack[-1][0], ()):
            stack.pop()
            _, outside, article, header = stack[-1] if stack else ("", False, False, False)
        if name in ("td", "th"):
            text(" ")
        out = outside or is_outside(name, m.attributes, article, m.start in around)
        if m.attributes.endswith("/") and name not in BLOCK:
            continue
        outside, header = out, header or (name == "header" and article)
        article = article or (name in ("article", "main") and not out)
        stack.append((name, outside, article, header))
    close_line()
    return lines, marked


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` are in a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    # longest rising run of places in b over the lines of a
    ends: list[int] = []
    chains: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            ends[k : k + 1] = [j]
            chains[k : k + 1] = [chain]
    shared = [i < head or i >= len(a) - tail for i in range(len(a))]
    chain = chains[-1] if chains else None
    while chain:
        shared[chain[0]] = True
        chain = chain[1]
    return shared


def _nearness(path: str, other: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))  # noqa: B905


def is_copy(lines: list[str], shared: list[bool]) -> bool:
    """Whether a neighbour that shares these lines is a copy: it leaves nothing, or half of the long lines at most."""
    long = [s for x, s in zip(lines, shared, strict=True) if len(x) >= LONG]
    return all(shared) or 2 * sum(long) >= len(long) > 0


def main_lines(page: tuple, around: list[tuple]) -> list[str]:
    """The text lines of a page, given its neighbours in order of distance; a page is (host, path, lines, marked).

    A page that marks its article is settled by that mark alone; differencing settles the others.
    """
    host, path, lines, marked = page
    if any(marked):
        return [x for x, m in zip(lines, marked, strict=True) if m]
    near = sorted((p for p in around if p[0] == host and p[2]), key=lambda p: -_nearness(path, p[1]))
    for other in near:
        shared = common_lines(lines, other[2])
        if not is_copy(lines, shared):
            return [x for x, s in zip(lines, shared, strict=True) if not s]
    return lines


def extract_main(pages: DataFrame) -> DataFrame:
    """The main text of every page."""
    pattern = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.lower(F.regexp_extract(url, pattern, 1)).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"),
    )

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: deque = deque(maxlen=5)  # two pages before, the page, two after
        out: list[tuple] = []

        def place(k: int) -> None:
            around = [window[i] for i in (k - 1, k + 1, k - 2, k + 2) if 0 <= i < len(window) and window[i]]
            ids, page = window[k][0], window[k][1]
            text = "\n".join(main_lines(page, [p[1] for p in around]))
            out.append((*ids, text, len(text)))

        def flushed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            out.clear()
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        window.extend([None, None])
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at].as_py() for n in ("page_id", "url", "html", "host", "path")}
                window.append(((row["page_id"], row["url"]), (row["host"], row["path"], *page_lines(row["html"] or ""))))
                if len(window) == 5 and window[2]:
                    place(2)
            yield flushed()
        for _ in range(2):  # the last two pages have fewer neighbours
            window.append(None)
            if len(window) == 5 and window[2]:
                place(2)
        yield flushed()

    ordered = pages.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return ordered.mapInArrow(difference, "page_id long, url string, text string, n_chars long")
