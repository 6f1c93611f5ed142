"""Saved web pages: main text by the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose text is not the page's own.
LEFT_OUT = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "template"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "article", "section", "blockquote", "pre", "table", "ul", "ol", "br"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = [[]]
        self.title: list[str] = []
        self.left_out = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in LEFT_OUT:
            self.left_out += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag in LEFT_OUT:
            self.left_out = max(0, self.left_out - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS:
            self.blocks.append([])

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.left_out:
            self.blocks[-1].append(data)


def read_html(page: str | None) -> tuple[str, str]:
    """Title and text (a line for each block) of a page."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    lines = (" ".join("".join(b).split()) for b in reader.blocks)
    return " ".join("".join(reader.title).split()), "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, text) of each page; null html gives empty ones."""
    kind = pages.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            read = [read_html(h) for h in part[html]]
            yield pd.DataFrame({key: part[key], "title": [t for t, _ in read], "text": [t for _, t in read]})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, title string, text string")
