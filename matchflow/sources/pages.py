"""Postings and descriptions from landed HTML pages: the tag tree needs a parser, so pages go through one in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Ampersands that begin no number's reference, with the name that follows up to a semicolon.
AMPERSAND = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")
#: Pages that are parsed at once; their rows leave before the next ones are read.
SLICE = 256


def plain_ampersands(html: str) -> str:
    """The html with ampersands written out where they begin no reference: one that a semicolon does not close, as in a cut text, is text."""
    return AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[1] or ''}", html)


@dataclass
class Element:
    """A tag with its attributes, as intervals: of the elements inside it, and of the words inside it."""

    tag: str
    classes: list[str]
    href: str | None
    at: int
    end: int
    first_word: int
    last_word: int


class Tree(HTMLParser):
    """Elements in document order over one list of words, in time linear in the page: an element's text is a slice.

    An element that is not closed reaches to the end of the one around it; words of scripts and styles are left out.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.words: list[str] = []
        self.open: list[Element] = []
        self.open_tags: Counter = Counter()
        self.found: dict[str, tuple[list[int], list[int]]] = {}
        self.feed(plain_ampersands(html))
        self.close()
        self.shut(0)

    def shut(self, depth: int) -> None:
        """Close the open elements from a depth on."""
        for element in self.open[depth:]:
            element.end, element.last_word = len(self.elements), len(self.words)
            self.open_tags[element.tag] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        said = dict(attrs)
        at, words = len(self.elements), len(self.words)
        element = Element(tag, (said.get("class") or "").split(), said.get("href"), at, at + 1, words, words)
        self.elements.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.open_tags[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.open_tags[tag]:  # else it closes nothing
            depth = len(self.open) - 1
            while self.open[depth].tag != tag:
                depth -= 1
            self.shut(depth)

    def handle_data(self, data: str) -> None:
        if not self.open_tags["script"] and not self.open_tags["style"]:
            self.words += data.split()

    def text(self, element: Element | None) -> str | None:
        return " ".join(self.words[element.first_word : element.last_word]) if element else None

    def matching(self, selector: str) -> tuple[list[int], list[int]]:
        """Places of the elements of a selector (tag, .class or tag.class), and of those with words."""
        if selector not in self.found:
            tag, _, name = selector.partition(".")
            places = [e.at for e in self.elements if (not tag or e.tag == tag) and (not name or name in e.classes)]
            self.found[selector] = places, [k for k in places if self.elements[k].last_word > self.elements[k].first_word]
        return self.found[selector]

    def every(self, selector: str, within: Element | None = None) -> list[Element]:
        """The elements of a selector, all of them or those inside an element."""
        places = self.matching(selector)[0]
        if within is not None:
            places = places[bisect_left(places, within.at + 1) : bisect_left(places, within.end)]
        return [self.elements[k] for k in places]

    def first(self, *selectors: str, within: Element | None = None) -> Element | None:
        """The first element of the first selector that has one with text."""
        for selector in selectors:
            places = self.matching(selector)[1]
            k = bisect_left(places, within.at + 1 if within else 0)
            if k < len(places) and (within is None or places[k] < within.end):
                return self.elements[places[k]]
        return None


def parsed(pages: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], fields: str) -> DataFrame:
    """page_id and the fields that `run` finds; ids travel as text, as a null beside them would turn them into floats.

    A batch is met SLICE pages at a time, so a task holds the batch and these pages' rows, however many pages a batch has.
    """
    sent = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                yield batch.slice(k, SLICE).to_pandas()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(slices(batches)):
            yield pa.RecordBatch.from_pandas(rows, schema=kinds, preserve_index=False)

    made = f"page_id string, {fields}"
    kinds = to_arrow_schema(StructType.fromDDL(made))
    return sent.mapInArrow(found, made).withColumn("page_id", F.col("page_id").cast("long"))


def extract_description(pages: DataFrame, selectors: tuple[str, ...] = (".description", "article", "main", "body")) -> DataFrame:
    """page_id and description: the text of the first container in order; null if a page has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf.page_id, "description": [(tree := Tree(h or "")).text(tree.first(*selectors)) for h in pdf.html]})

    return parsed(pages, run, "description string")


def extract_cards(pages: DataFrame, title: tuple[str, ...] = ("h2", "h3", ".job-title", "h1")) -> DataFrame:
    """page_id, card, title, url: one row for each link with a text, its address made absolute; pages without any keep one row with their own address."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, base, html in zip(pdf.page_id, pdf.url, pdf.html, strict=True):
                tree = Tree(html or "")
                heading = tree.text(tree.first(*title))
                cards = [e for e in tree.every("a") if e.href and e.last_word > e.first_word]
                for k, e in enumerate(cards):
                    rows.append((page_id, k, tree.text(e), urljoin(base or "", e.href)))
                if not cards:
                    rows.append((page_id, 0, heading, base))
            yield pd.DataFrame(rows, columns=["page_id", "card", "title", "url"])

    return parsed(pages, run, "card int, title string, url string")


@dataclass(frozen=True)
class Board:
    """Where a board keeps its cards and their fields; of the selectors the first with a hit counts."""

    cards: tuple[str, ...]
    title: tuple[str, ...] = ("h2", "h3", ".job-title", "a")
    company: tuple[str, ...] = (".company", ".recruiter-name", "span.company-name")
    location: tuple[str, ...] = (".location",)
    posted: tuple[str, ...] = ("time", ".date")
    link: tuple[str, ...] = ("a",)
    #: Part of the addresses that are postings on a page without cards.
    view: str | None = None


#: The classes that the boards give to their cards and fields.
BOARDS = {
    "linkedin": Board(
        cards=("div.base-card",),
        title=("h3.base-search-card__title",),
        company=("h4.base-search-card__subtitle",),
        location=("span.job-search-card__location",),
        posted=("time",),
        link=("a.base-card__full-link",),
    ),
    "jobsie": Board(cards=("article.job", "div.job-result", "li.jobs-item"), location=(), view="/jobs/view"),
}


def board_cards(pages: DataFrame, board: Board, location: str = "N/A") -> DataFrame:
    """page_id, card, title, company, location, posted, url: a row for each container of the first card selector with any.

    Missing fields are N/A (the location: that asked for), a missing link gives an empty url, and one that cannot be
    joined to the page's address leaves its card out. A page without cards gives its links whose address holds
    `board.view`; pages without these, and null pages, give no row.
    """

    def found(html: str) -> Iterator[tuple]:
        tree = Tree(html)
        cards = next(filter(None, map(tree.every, board.cards)), [])
        if not cards and board.view:
            for e in tree.every("a"):
                if board.view in (e.href or ""):
                    yield tree.text(e), "See listing", location, "N/A", e.href
        for card in cards:
            said = lambda selectors: tree.text(tree.first(*selectors, within=card))  # noqa: B023, E731
            link = next((e.href for s in board.link for e in tree.every(s, card) if e.href), None)
            yield said(board.title) or "N/A", said(board.company) or "N/A", said(board.location) or location, said(board.posted) or "N/A", link

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, base, html in zip(pdf.page_id, pdf.url, pdf.html, strict=True):
                for k, (*said, link) in enumerate(found(html or "")):
                    try:
                        rows.append((page_id, k, *said, urljoin(base or "", link) if link else ""))
                    except ValueError:  # an address that is none
                        continue
            yield pd.DataFrame(rows, columns=["page_id", "card", "title", "company", "location", "posted", "url"])

    return parsed(pages, run, "card int, title string, company string, location string, posted string, url string")
