"""HTML parsing and address resolution: the Python part, vectorised over Arrow batches.

The parser is the standard library's. Article text is what stands in
``<article>``, else in ``<p>`` elements, else all visible text; scripts,
styles and page frames are left out. A main-content extractor with learned
heuristics would differ in detail.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = {"script", "style", "nav", "footer", "aside", "noscript", "template"}
LINKS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("anchor", T.StringType())]))
ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("text_length", T.IntegerType())])


class Page(HTMLParser):
    """Links, first heading, title, paragraphs, article text and all text of a page."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.links: list[list] = []
        self.heading: list[str] | None = None
        self.title: list[str] = []
        self.paragraphs: list[list[str]] = []
        self.article: list[str] = []
        self.visible: list[str] = []
        self.open: dict[str, int] = {}
        self.hidden = 0
        self.heading_done = False
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in FRAMES:
            self.hidden += 1
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "a":
            self.links.append([dict(attrs).get("href"), []])
        elif tag == "h1" and self.heading is None:
            self.heading = []
        elif tag == "p":
            self.paragraphs.append([])

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self.open[tag] -= 1
            if tag in FRAMES:
                self.hidden -= 1
        if tag == "h1" and self.heading is not None:
            self.heading_done = True
        if tag == "p":
            self.open["p"] = 0

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if self.open.get("a") and self.links:
            self.links[-1][1].append(text)
        if self.open.get("title"):
            self.title.append(text)
            return
        if self.open.get("h1") and not self.heading_done and self.heading is not None:
            self.heading.append(text)
        if self.hidden:
            return
        self.visible.append(text)
        if self.open.get("article"):
            self.article.append(text)
        if self.open.get("p") and self.paragraphs:
            self.paragraphs[-1].append(text)


@F.pandas_udf(LINKS)
def links_in(markup: pd.Series) -> pd.Series:
    """All links of a page, in order: (href, anchor text)."""
    return markup.map(lambda m: [{"href": h, "anchor": " ".join(words)} for h, words in Page(m or "").links])


@F.pandas_udf(ARTICLE)
def parse_article(markup: pd.Series) -> pd.DataFrame:
    """Title (first heading), text and its length."""

    def one(m: str | None):
        page = Page(m or "")
        text = "\n".join(page.article) or "\n".join(x for p in page.paragraphs if (x := " ".join(p))) or "\n".join(page.visible)
        return " ".join(page.heading or []), text, len(text)

    return pd.DataFrame([one(m) for m in markup], columns=["title", "text", "text_length"])


@F.pandas_udf(ARTICLE)
def parse_paragraphs(markup: pd.Series) -> pd.DataFrame:
    """Title (the page's) and the paragraphs of over 40 characters."""

    def one(m: str | None):
        page = Page(m or "")
        text = "\n".join(x for p in page.paragraphs if len(x := " ".join(p)) > 40)
        return " ".join(page.title), text, len(text)

    return pd.DataFrame([one(m) for m in markup], columns=["title", "text", "text_length"])


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b or "", h or "")
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)])


def resolve(base: Column, href: Column) -> Column:
    """``href`` against ``base``; absolute addresses without dot segments skip Python."""
    plain = href.rlike("^https?://[^/?#]+") & ~href.rlike(r"/\.\.?(/|$|[?#])|[\t\r\n]|^\s|\s$|#$|\?$")
    return F.when(plain, href).otherwise(_joined(base, F.when(~plain, href)))
