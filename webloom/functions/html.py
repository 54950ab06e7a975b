"""Title, text and links of HTML pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from webloom.functions.urls import canonical_url

# Elements without readable text, names that mark navigation, schemes that are no pages.
STRIPPED = frozenset({"script", "style", "noscript", "svg", "nav", "header", "footer", "aside"})
NAVIGATION = re.compile(r"\b(nav|menu|footer|header|sidebar)\b", re.I)
NO_PAGES = ("mailto:", "tel:", "javascript:", "data:")

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class _Page(HTMLParser):
    """One pass that keeps the open elements and how many of them are stripped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.hidden = 0
        self.text: list[str] = []
        self.links: list[str] = []
        self.og: str | None = None
        self.title: list[str] | None = None
        self.h1: list[str] | None = None
        self._into: list[str] | None = None
        self._inside = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(reversed(attrs))
        for gone in _CLOSES.get(tag, ()):
            if self.open and self.open[-1][0] == gone:
                self._close(gone)
        if tag == "meta" and self.og is None and a.get("property") == "og:title":
            self.og = (a.get("content") or "").strip()
        if tag == "a" and a.get("href") is not None:
            self.links.append(a["href"])
        if tag == "title" and self.title is None:
            self.title = self._into = []
            self._inside = tag
        if tag == "h1" and self.h1 is None:
            self.h1 = self._into = []
            self._inside = tag
        if tag in _VOID:
            return
        strip = tag in STRIPPED or (a.get("role") or "").lower() == "navigation" or "navigation" in (a.get("aria-label") or "").lower()
        strip = strip or any(NAVIGATION.search(a.get(k) or "") for k in ("class", "id"))
        self.open.append((tag, strip))
        self.hidden += strip

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        while self.open:
            name, strip = self.open.pop()
            self.hidden -= strip
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == self._inside:
            self._into, self._inside = None, ""
        if any(name == tag for name, _ in self.open):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self._into is not None:
            self._into.append(data.strip())
        if not self.hidden and data.strip():
            self.text.append(data.strip())


def parse_page(html: str, base_url: str | None = None) -> tuple[str, str, int, list[str]]:
    """(title, text, text length, links).

    The title is the page's og:title, else its title, else its first heading.
    The text leaves out scripts, styles and navigation. Links are canonical,
    different, in order; those without a canonical form are left out.
    """
    page = _Page()
    page.feed(html)
    page.close()
    title = page.og or "".join(page.title or []) or "".join(page.h1 or [])
    text = re.sub(r"\s+", " ", " ".join(page.text)).strip()
    links: dict[str, None] = {}
    for href in page.links:
        href = href.strip()
        if not href or href.startswith("#") or href.lower().startswith(NO_PAGES):
            continue
        try:
            links[canonical_url(href, base_url)] = None
        except ValueError:
            continue
    return title, text, len(text), list(links)


PARSED = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("text_length", IntegerType()), StructField("links", ArrayType(StringType()))])


@F.pandas_udf(PARSED)
def _parsed(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None, None) if h is None else parse_page(h, b) for h, b in zip(html, base)], columns=["title", "text", "text_length", "links"], index=html.index)


def parse_html(html: Column, base_url: Column) -> Column:
    """``parse_page`` for columns: a struct, null fields for null HTML."""
    return _parsed(html, base_url)
