"""Stored-HTML jobs (T13-T15): main text, title and links, listing items.

The ``<article>`` form is extracted natively with regexes (no Python worker).  Pages that need a
real parser go through ``mapInPandas`` with the standard-library ``html.parser``: one parser per
page, Arrow batches in and out, output rows emitted per page (UDTF-like).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens import config as C
from postlens.functions import text as T
from postlens.session import ship

ARTICLE_RE = "(?s)<article[^>]*>(.*?)</article>"
TITLE_RE = "(?s)<title[^>]*>(.*?)</title>"
SCRIPT_RE = "(?s)<(script|style)[^>]*>.*?</(script|style)>"
HREF_RE = "href=\"([^\"]*)\""
# an address in double quotes, in single ones or in none
ANY_HREF_RE = "(?i)\\bhref\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>\"']+)"


def article_text(html) -> Column:
    """T13 native form: inner text of the first ``<article>``; scripts/styles dropped, tags
    stripped, entities decoded, blanks collapsed."""
    inner = F.regexp_extract(html, ARTICLE_RE, 1)
    inner = F.regexp_replace(inner, SCRIPT_RE, " ")
    inner = F.regexp_replace(inner, T.TAG_RE, " ")
    for ent, rep in C.HTML_ENTITIES:
        inner = F.replace(inner, F.lit(ent), F.lit(rep))
    return T.strip_blank(T.collapse_blank(inner))


def page_title(html) -> Column:
    t = F.regexp_extract(html, TITLE_RE, 1)
    for ent, rep in C.HTML_ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(rep))
    return T.strip_blank(T.collapse_blank(t))


def page_links(html) -> Column:
    """The addresses of all links, however they are quoted."""
    first = F.transform(F.regexp_extract_all(html, F.lit(ANY_HREF_RE), 1), lambda x: F.struct(x.alias("x"), F.substring(x, 1, 1).alias("q")))
    return F.transform(first, lambda s: F.when(s["q"].isin('"', "'"), F.substring(s["x"], F.lit(2), F.length(s["x"]) - 2)).otherwise(s["x"]))


VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset(["script", "style"])


class _Page(HTMLParser):
    """A parser whose work grows with the page, however broken its markup is.

    ``open`` holds the open elements and ``at`` the places of each tag in it, so no look for an open
    element walks through others.  Behind the last ``>`` no tag can end: there ``<`` is text, which
    the standard parser would find out again from every such place.  A comment that never ends, and a
    declaration that the standard parser refuses, hide the rest of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)

    def last(self, *tags: str) -> int:
        """Place of the innermost open element with one of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def cut(self, depth: int) -> None:
        """Close the elements from place ``depth`` on."""
        while len(self.open) > depth:
            self.at[self.open.pop()].pop()

    def read(self, html: str | None):
        html = html or ""
        hidden = html.find("<!--", html.rfind("-->") + 1)
        html = html[:hidden] if hidden >= 0 else html
        end = html.rfind(">") + 1
        try:
            self.feed(html[:end] + html[end:].replace("<", "&lt;"))
            self.close()
        except AssertionError:
            pass
        return self


class _TextParser(_Page):
    """Collects items: <li> anywhere, paragraphs inside <article>.  An item ends with its own end tag,
    with the next item, or with the element around it."""

    def __init__(self):
        super().__init__()
        self.items: list[tuple[str, str, str]] = []
        self._cur: list[str] | None = None
        self._cur_tag, self._href, self._depth = "", "", 0

    def _flush(self):
        if self._cur is not None:
            text = " ".join("".join(self._cur).split())
            if text:
                self.items.append((self._cur_tag, text, self._href))
        self._cur = None

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        if tag == "li" or (tag == "p" and self.at.get("article")):
            if tag == "p" and self._cur_tag == "li" and self._cur is not None:
                pass                                  # a paragraph inside a list item belongs to it
            else:
                self._flush()
                self._cur, self._cur_tag, self._href, self._depth = [], tag, "", len(self.open)
        self.push(tag)
        if tag == "a" and self._cur is not None:
            self._href = dict(attrs).get("href") or self._href

    def handle_endtag(self, tag):
        place = self.last(tag)
        if place >= 0:
            self.cut(place)
            if self._cur is not None and len(self.open) <= self._depth:
                self._flush()

    def handle_data(self, data):
        if self.open and self.open[-1] in RAW_TAGS:
            return
        if self._cur is not None:
            self._cur.append(data)

    def read(self, html):
        super().read(html)
        self._flush()
        return self


# fixed values: where each site class keeps its main text, in the order tried
CASCADES = {
    "naver_news": ["div#dic_area", "div#articleBodyContents", "div#newsEndContents", "div#articeBody"],
    "naver_blog": ["div.se-main-container", "div.__se_component_area", "div#viewTypeSelector", "div.post-view",
                   "div.post_ct", "div.se_component_wrap"],
    "naver_cafe": ["div.se-main-container", "div.article_container", "div.ContentRenderer", "div.article", "div#tbody"],
    "general": ["article", "div.content", "div.article-content", "div.post-content", "main", "div.main-content"],
}
LEFT_OUT = {"naver_news": ["a.link_news", "a.link_end"]}
WITH_BODY = ("general", "naver_cafe")

# fixed values: the blocks of a board's result page
BOARD_RESULTS = {"list": "ul.sch_result_list", "item": "li", "title": "a.sch_tit", "author": ".user_nick",
                 "date": ".date", "skip": "td.notice", "no_author": "Unknown"}

# an element of the key's kind ends an open one of its kind, unless one of these lies between
ENDS_ITS_KIND = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def _selector(text: str) -> tuple[str, str, str]:
    """``tag``, ``tag.class``, ``.class`` or ``tag#id`` -> (tag, class, id)"""
    tag, _, ident = text.partition("#")
    tag, _, cls = tag.partition(".")
    return tag, cls, ident


def _matches(sel: tuple[str, str, str], tag: str, attrs: dict) -> bool:
    want_tag, cls, ident = sel
    return (not want_tag or tag == want_tag) and (not cls or cls in (attrs.get("class") or "").split()) \
        and (not ident or attrs.get("id") == ident)


class _Blocks(_Page):
    """Keeps the open elements and the blocks whose text is being gathered; subclasses say which
    elements open a block.  Tags separate words; scripts and styles hold none."""

    def __init__(self):
        super().__init__()
        self.blocks: list[tuple[int, list[str]]] = []        # depth of the block's element, its text

    def gather(self) -> list[str]:
        text: list[str] = []
        self.blocks.append((len(self.open), text))
        return text

    def opened(self, tag: str, attrs: dict) -> None:
        raise NotImplementedError

    def closed(self, depth: int) -> None:
        pass

    def _cut(self, depth: int) -> None:
        self.cut(depth)
        while self.blocks and self.blocks[-1][0] >= depth:
            self.blocks.pop()
        self.closed(depth)

    def _space(self) -> None:
        for _, text in self.blocks:
            text.append(" ")

    def handle_starttag(self, tag, attrs):
        self._space()
        if tag in VOID_TAGS:
            return
        if tag in ENDS_ITS_KIND:
            place = self.last(tag)
            if place > self.last(*ENDS_ITS_KIND[tag]):
                self._cut(place)
        self.opened(tag, dict(attrs))
        self.push(tag)

    def handle_endtag(self, tag):
        self._space()
        place = self.last(tag)
        if place >= 0:
            self._cut(place)

    def handle_data(self, data):
        if self.open and self.open[-1] in RAW_TAGS:
            return
        for _, text in self.blocks:
            text.append(data)

    def read(self, html: str | None):
        super().read(html)
        self._cut(0)
        return self


def _joined(parts: list[str] | None) -> str:
    return " ".join("".join(parts or []).split())


class _MainText(_Blocks):
    """The first element of each selector, and the body"""

    def __init__(self, site_class: str):
        super().__init__()
        self.names = CASCADES[site_class] + (["body"] if site_class in WITH_BODY else [])
        self.selectors = [_selector(n) for n in self.names]
        self.left_out = [_selector(n) for n in LEFT_OUT.get(site_class, [])]
        self.texts: dict[str, list[str]] = {}
        self.muted: int | None = None

    def opened(self, tag, attrs):
        for name, sel in zip(self.names, self.selectors):
            if name not in self.texts and _matches(sel, tag, attrs):
                self.texts[name] = self.gather()
        if self.muted is None and any(_matches(s, tag, attrs) for s in self.left_out):
            self.muted = len(self.open)

    def closed(self, depth):
        if self.muted is not None and depth <= self.muted:
            self.muted = None

    def handle_data(self, data):
        if self.muted is None:
            super().handle_data(data)


class _Listing(_Blocks):
    """Items of a result list with title, link, author and date"""

    def __init__(self, rule: dict):
        super().__init__()
        self.sel = {k: _selector(v) for k, v in rule.items() if k != "no_author"}
        self.lists: list[int] = []
        self.item: dict | None = None
        self.items: list[dict] = []

    def opened(self, tag, attrs):
        if self.item is None:
            if self.lists and self.lists[-1] == len(self.open) - 1 and _matches(self.sel["item"], tag, attrs):
                self.item = {"depth": len(self.open), "skip": False}
        else:
            self.item["skip"] |= _matches(self.sel["skip"], tag, attrs)
            for part in ("title", "author", "date"):
                if part not in self.item and _matches(self.sel[part], tag, attrs):
                    self.item[part] = self.gather()
                    if part == "title":
                        self.item["href"] = attrs.get("href")
        if _matches(self.sel["list"], tag, attrs):
            self.lists.append(len(self.open))

    def closed(self, depth):
        if self.item is not None and depth <= self.item["depth"]:
            self.items.append(self.item)
            self.item = None
        while self.lists and self.lists[-1] >= depth:
            self.lists.pop()


def main_text(html: str | None, site_class: str, accept) -> tuple[str | None, str | None]:
    """(selector, text) of the first candidate that ``accept`` takes, or (None, None)"""
    found = _MainText(site_class).read(html).texts
    for name in CASCADES[site_class] + ["body"]:
        text = _joined(found.get(name))
        if name in found and accept(text):
            return name, text
    return None, None


def parsed_main_text(pages: DataFrame, min_chars: int = 50, char_class: str = "[A-Za-z]") -> DataFrame:
    """T13 parser form over (page_id, html, site_class): the selectors of the class in order, then for
    some classes the body; the first text that F8 (parameter class) accepts.  Pages without one have
    null selector and text."""
    rx = re.compile(char_class)
    ship(pages.sparkSession)

    def accept(text: str) -> bool:
        return len(rx.findall(text)) >= min_chars

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [main_text(h, c, accept) for h, c in zip(b["html"], b["site_class"])]
            yield pd.DataFrame({"page_id": b["page_id"], "site_class": b["site_class"],
                                "selector": pd.Series([g[0] for g in got], dtype=object, index=b.index),
                                "text": pd.Series([g[1] for g in got], dtype=object, index=b.index)})

    return pages.select("page_id", "html", "site_class").mapInPandas(
        run, "page_id long, site_class string, selector string, text string")


def listing_rows(html: str | None, rule: dict) -> list[tuple]:
    """(title, url, author, date) of a page's items.  Items without title or link, and notices, are
    left out; a missing author has the rule's name, a missing date is None."""
    rows = []
    for it in _Listing(rule).read(html).items:
        title, href = _joined(it.get("title")), it.get("href")
        if it["skip"] or not title or not href:
            continue
        author = _joined(it["author"]) if "author" in it else rule["no_author"]
        rows.append((title, href, author, _joined(it["date"]) if "date" in it else None))
    return rows


def listing(pages: DataFrame, rule: dict) -> DataFrame:
    """T15 over (page_id, html): one row per listed item, in page order."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(pid, i, *r) for pid, h in zip(b["page_id"], b["html"]) for i, r in enumerate(listing_rows(h, rule))]
            yield pd.DataFrame(rows, columns=["page_id", "item_no", "title", "url", "author", "published_date"])

    return pages.select("page_id", "html").mapInPandas(
        run, "page_id long, item_no int, title string, url string, author string, published_date string")


def page_items(pages: DataFrame) -> DataFrame:
    """N rows per page (list links and article paragraphs) with their position."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, h in zip(b["page_id"], b["html"]):
                for i, (tag, text, href) in enumerate(_TextParser().read(h).items):
                    rows.append((pid, i, tag, text, href))
            yield pd.DataFrame(rows, columns=["page_id", "item_no", "tag", "text", "href"])

    return pages.select("page_id", "html").mapInPandas(
        run, "page_id long, item_no int, tag string, text string, href string")
