"""Titles, links and text of HTML pages, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.paragraphs, self.links, self.open = "", [], 0, []

    def handle_starttag(self, tag, attrs):
        self.open.append(tag)
        self.links += tag == "a" and any(k == "href" for k, _ in attrs)
        if tag == "p":
            self.paragraphs.append("")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.open:
            self.title += data
        elif "p" in self.open and "script" not in self.open and "style" not in self.open:
            self.paragraphs[-1] += data


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, n_paragraphs and text; null html gives empty values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                reader = _Reader()
                reader.feed(html or "")
                reader.close()
                found = [p for p in (" ".join(p.split()) for p in reader.paragraphs) if p]
                out.append((page_id, " ".join(reader.title.split()), reader.links, len(found), "\n".join(found)))
            yield pd.DataFrame(out, columns=["page_id", "title", "n_links", "n_paragraphs", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, n_links int, n_paragraphs int, text string")
