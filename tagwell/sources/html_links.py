"""Links of HTML pages: what a listing offers for download."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "page_id long, position int, href string, text string"


class _Links(HTMLParser):
    """Anchors with their text; scripts and styles are no content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            href = dict(attrs).get("href")
            self.inside = href is not None
            if self.inside:
                self.found.append([href, ""])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.found[-1][1] += data


def links(html: str | None) -> list[tuple[str, str]]:
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return [(href, " ".join(text.split())) for href, text in parser.found]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, position, href and text of each link, in the page's order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(page_id, i, *found) for page_id, html in zip(frame["page_id"], frame["html"], strict=True) for i, found in enumerate(links(html))]
            yield pd.DataFrame(rows, columns=["page_id", "position", "href", "text"])

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)
