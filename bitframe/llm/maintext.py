"""The main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one for each block of text. A line weighs as many characters as it has outside links (in an article that the page marks by an element or role: all); what stands in an
element for navigation, adverts, forms, comments and the like (by its tag, its role or the words of its class and id) is gone, and leaves an empty line.
Where a page marks its article, lines outside weigh nothing. The weights of every ``WINDOW`` lines in a row are summed: where the sum surges from nothing
a block begins, where it dives to nothing it ends, and a block is kept if one of its sums reaches ``SHARE`` of the greatest of the page, or if
the page marks its article. What is kept is all text between the block's first and last line that weigh anything.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow

WINDOW, SHARE = 3, 0.25
#: Elements whose text no reader sees, or that hold controls.
UNSEEN = {"head", "script", "style", "noscript", "template", "title", "svg", "iframe", "object", "canvas", "audio", "video", "button", "select", "textarea", "datalist"}
#: Elements, roles, and last words of classes and ids that aren't the article.
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
OTHER = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "sponsors", "promo", "promotion", "banner", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "topbar", "header", "masthead", "footer", "comment",
    "comments", "commentlist", "respond", "reply", "replies", "disqus", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "searchform", "share", "sharing",
    "social", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "widget", "widgets", "toolbar", "pagination", "pager", "copyright", "disclaimer", "paywall", "hidden",
}
#: Words of classes and ids that say nothing of what is inside.
NEUTRAL = {"area", "list", "section", "wrapper", "wrap", "container", "box", "block", "inner", "outer", "slot", "unit", "item", "left", "right", "top", "bottom", "panel", "bar", "body", "content", "text", "group", "row", "col", "column", "site", "page", "main", "message", "form", "thread"}
#: Classes and ids that mark the article, and how surely.
MARKS = {"articlebody": 3, "post": 2, "entry": 2, "story": 2, "article": 2, "content": 1, "main": 1}
SPACED = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "ul", "option", "optgroup",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "template", "noscript", "iframe"}
SIBLINGS = {"p", "li", "td", "th", "tr", "dt", "dd", "option"}
KNOWN = UNSEEN | ASIDE | {"article", "main"}
_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<!\S)(hidden)(?!\S)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RIGHTS = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.IGNORECASE)


def _kind(tag: str, attributes: str, marked: bool) -> tuple[bool, int]:
    """Whether an element isn't part of an article, and how surely it marks one. ``marked``: it stands within an article."""
    if tag in UNSEEN or tag in ASIDE and not (tag == "header" and marked):
        return True, 0
    mark = {"article": 5, "main": 4}.get(tag, 0)
    if not attributes.strip():
        return False, mark
    at = {m[1].lower() if m[1] else "hidden": html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)}
    role = at.get("role", "").lower()
    if tag not in ("body", "html") and (role in ROLES or "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", ""), re.IGNORECASE)):
        return True, 0
    mark = max(mark, {"article": 5, "main": 4}.get(role, 0), 5 if at.get("itemprop", "").lower() == "articlebody" else 0)
    for name in [*at.get("class", "").split(), *at.get("id", "").split()]:
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in ("has", "with", "no", "not", "without", "is"):
            continue
        said = [w for w in words if w not in NEUTRAL and not w.isdigit()]
        if tag not in ("body", "html", "main") and said and said[-1] in OTHER:
            return True, 0
        mark = max(mark, MARKS.get("".join(words), 0), *(MARKS.get(w, 0) for w in words if words[-1] in ("body", "content", "text", "main")), 0)
    return False, 0 if tag in ("body", "html") else mark


class _Open:
    """The open elements of a page: what they are, and where the topmost of each name and of those left out stands."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, bool]] = []  # name, left out, the surest mark of it and those around it, whether it is one of those that hold articles of others
        self.named: dict[str, list[int]] = {}
        self.out: list[int] = []

    def push(self, tag: str, left_out: bool, mark: int, others: bool) -> None:
        self.named.setdefault(tag, []).append(len(self.stack))
        if left_out:
            self.out.append(len(self.stack))
        self.stack.append((tag, left_out, max(mark, self.mark), others or self.others))

    def cut(self, depth: int) -> bool:
        """Close all from ``depth`` on; whether something left out ended, and nothing left out is open."""
        was = bool(self.out)
        while len(self.stack) > depth:
            self.named[self.stack.pop()[0]].pop()
        while self.out and self.out[-1] >= depth:
            self.out.pop()
        return was and not self.out

    @property
    def mark(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    @property
    def others(self) -> bool:
        return bool(self.stack) and self.stack[-1][3]


def lines_of(page: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A page's blocks of text in order, empty ones where something was left out, their characters outside links, and how surely each is in a marked article."""
    lines: list[str] = []
    weights: list[int] = []
    marks: list[int] = []
    parts: list[str] = []
    free: list[str] | None = None  # the parts outside links, where there are links
    opened, links, at, n, last = _Open(), False, 0, len(page), page.rfind(">")
    unclosed: set[str] = set()

    def end(empty: bool = False) -> None:
        nonlocal free
        shown = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if shown or empty:
            lines.append(shown)
            outside = len(shown) if free is None or opened.mark >= 4 else len(" ".join(html.unescape("".join(free)).split()))
            weights.append(0 if not opened.mark and _RIGHTS.search(shown) else outside)
            marks.append(opened.mark)
        parts.clear()
        free = None

    def say(text: str) -> None:
        nonlocal free
        if not opened.out:
            if links and free is None:
                free = parts.copy()
            elif free is not None and not links:
                free.append(text)
            parts.append(text)

    while at < n:
        lt = page.find("<", at)
        lt = n if lt < 0 else lt
        if lt > at:
            say(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            at = page.find("-->", lt + 2)
            at = n if at < 0 else at + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt)
            at = n if at < 0 else at + 1
            continue
        m = (_TAG.match(page, lt) or _PLAIN.match(page, lt)) if lt < last else None
        if not m:
            say("&lt;")
            at = lt + 1
            continue
        at, tag = m.end(), m[1].lower()
        spaced = tag in SPACED
        if page[lt + 1] == "/":
            links = links and tag != "a"
            depth = opened.named[tag][-1] if opened.named.get(tag) else None
            if spaced and not opened.out:
                end()
            if depth is not None and (spaced or not opened.out or opened.out[-1] <= depth) and opened.cut(depth):
                end(True)
            continue
        attributes = m[2]
        if tag in RAW and not attributes.endswith("/"):
            close = None if tag in unclosed else re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(page, at)
            if close:
                at = page.find(">", close.start())
                at = n if at < 0 else at + 1
            elif tag in ("script", "style"):
                at = n
            else:
                unclosed.add(tag)
            continue
        if opened.out and tag in ("body", "article", "main") and not opened.others:
            opened.cut(opened.out[0])  # what was left open before it, such as a head or an advert, doesn't hold it
        if spaced:
            if not opened.out:
                end()
        elif tag == "br":
            say(" ")
        if tag in VOID or not spaced and attributes.endswith("/"):
            continue
        if tag == "a":
            links = "href" in attributes
        if tag in SIBLINGS and opened.stack and opened.stack[-1][0] == tag:
            opened.cut(len(opened.stack) - 1)
        left_out, mark = _kind(tag, attributes, opened.mark >= 4) if attributes or tag in KNOWN else (False, 0)
        if left_out and not opened.out:
            end(True)
        opened.push(tag, left_out, mark, left_out and (tag in ("aside", "nav", "form", "dialog") or "comment" in attributes.lower() or "related" in attributes.lower()))
    end()
    return lines, np.array(weights, np.int64), np.array(marks, np.int64)


def extract(page: str) -> str:
    """The main text of a page, its blocks joined by one space."""
    lines, weight, mark = lines_of(page)
    if not weight.any():
        return ""
    surest = mark.max(where=weight > 0, initial=0)
    used = np.where(mark == surest, weight, 0) if surest else weight
    sums = np.convolve(used, np.ones(WINDOW, np.int64))  # the window that ends at each line, with those at the end of the page
    rises = np.flatnonzero(np.diff((sums > 0).astype(np.int8), prepend=0, append=0))
    least = 0 if surest else SHARE * sums.max()
    kept = []
    for surge, dive in zip(rises[::2].tolist(), rises[1::2].tolist(), strict=True):
        if sums[surge:dive].max() >= least:
            filled = np.flatnonzero(used[surge : min(dive, len(used))]) + surge
            kept += [x for x, m in zip(lines[filled[0] : filled[-1] + 1], mark[filled[0] : filled[-1] + 1].tolist(), strict=True) if x and m >= surest]
    return " ".join(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Null and empty pages, and those without any text outside links, have an empty text. Ids and urls may be null or repeat; other columns are ignored. A
    page is worked on whole, in one task; an unclosed script or comment ends its page, as it does in browsers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                texts = [extract(x or "") for x in batch.column(2)[i : i + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 256], batch.column(1)[i : i + 256], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return arrow(plain, run, "page_id bigint, url string, text string, n_chars bigint")
