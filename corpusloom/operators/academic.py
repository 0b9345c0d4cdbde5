"""Pages of an academic portal: title, authors, year, index marks, journal, abstract, key words and text of an article.

A page is read into a small tree of elements; each field has its own list of places, of which the first that is
there wins. The tree needs nesting, which no pattern follows, so this is an Arrow UDF over batches of pages.

Cases: null and empty pages give empty fields; an element that never ends reaches to the end of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_slug

FIELDS = "title string, authors string, authors_count int, year int, journal string, annotation string, keywords string, keywords_count int, rsci boolean, vak boolean, scopus boolean, text string, text_length int, text_source string"
#: Places of the abstract, the key words and the text as (element, attribute, value), and the least length of a text.
ABSTRACT = (("div", "class", "abstract"), ("section", "class", "abstract"), ("div", "itemprop", "description"))
KEYWORDS = (("div", "class", "keywords"), ("span", "itemprop", "keywords"), ("meta", "name", "keywords"))
BODY = (("div", "class", "ocr"), ("div", "itemprop", "articleBody"), ("section", "class", "body"), ("div", "id", "body"), ("article", None, None))
INDEXES = ("rsci", "vak", "scopus")
LEAST_TEXT = 300
KEYWORDS_LINE = re.compile(r"Ключевые\s*слова[:：]?\s*")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.inside = tag, attributes, []

    def nodes(self) -> Iterator[Node]:
        """All elements below, in page order."""
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.nodes()

    def strings(self) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, Node):
                yield from x.strings()
            elif x.strip():
                yield x.strip()

    def has(self, name: str | None, value: str | None) -> bool:
        """Whether an attribute is the value, or, of a class, has all of its words."""
        own = self.attributes.get(name or "", "")
        return name is None or own == value or name == "class" and " " not in value and value in own.split()

    def first(self, tag: str, name: str | None = None, value: str | None = None) -> Node | None:
        return next((x for x in self.nodes() if x.tag == tag and x.has(name, value)), None)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), None)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].inside.append(data)


def listed(text: str) -> int:
    """Parts between commas that aren't blank."""
    return sum(bool(x.strip()) for x in text.split(","))


def read_page(html: str | None) -> tuple:
    """The fields of one page, in the order of FIELDS."""
    root = Tree(html or "").root
    joined = lambda node, by="": by.join(node.strings()) if node else ""
    head = root.first("h2", "class", "right-title")
    line = joined(head.first("span") if head else None)
    authors = line.partition("—")[2].strip() if "—" in line else line
    marks = root.first("div", "class", "labels")
    stamp = joined(marks.first("time")) if marks and marks.first("time") else ""
    index = {x for node in (marks.nodes() if marks else ()) if node.tag == "div" for x in INDEXES if {"label", x} <= set(node.attributes.get("class", "").split())}
    annotation = next((joined(x, " ") for x in (root.first(*p) for p in ABSTRACT) if x), "")
    keywords = ""
    for place in KEYWORDS:
        node = root.first(*place)
        keywords = (node.attributes.get("content", "") if place[0] == "meta" else joined(node, ", ")) if node else ""
        if keywords:
            break
    else:
        line = next((x for x in (joined(n, " ") for n in root.nodes() if n.tag in ("p", "div")) if x.startswith("Ключевые слова")), "")
        keywords = KEYWORDS_LINE.sub("", line).strip()
    text = next((t for t in (joined(x, " ") for x in (root.first(*p) for p in BODY) if x) if len(t) > LEAST_TEXT), "")
    year = int(stamp) if re.fullmatch(r"[+-]?\d{1,9}", stamp) else None
    return (joined(root.first("i")), authors, listed(authors), year, joined(root.first("a", "class", "link")), annotation, keywords, listed(keywords), *(x in index for x in INDEXES), text, len(text), "html_ocr" if text else "")


def page_fields(html) -> Column:
    """struct of FIELDS of a page."""

    @F.pandas_udf(f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def read(pages: pd.Series) -> pd.DataFrame:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        frame = pd.DataFrame([read_page(p) for p in pages], columns=names)
        return frame.astype({"year": "Int32"})

    return read(html)


def academic_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """article_id, url and the fields of each page; of a page without a text, the caller's PDF text may take its place."""
    return pages.select(article_slug(F.col(url)).alias("article_id"), url, page_fields(F.col(html)).alias("_f")).select("article_id", url, "_f.*")
