"""A Spark data source for folders of feeds: `spark.read.format("feeds").load(folder)`.

The folder holds one subfolder `source=NAME` for each feed, with the feed's document in text files (RSS, Atom or a
sitemap). Every feed is a partition of its own, so feeds are read by as many tasks as there are; conditions on the source
(`=`, `IN`) are pushed down to the listing, and feeds that they leave out are never opened. The folder must be one that
driver and executors share.

Options: `most` (items of a feed, 50). Rows: source, kind (rss, atom, sitemap), at (place in the feed, from 0), url,
title, published (as written), error. A document that can't be read gives one row with its error, so that other feeds
go on; a feed without items gives none.
"""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "source string, kind string, at int, url string, title string, published string, error string"
#: What an item, its address and its time are called in each kind of document.
ITEMS = {"rss": ("item", "link", ("pubDate", "dc:date")), "atom": ("entry", "link", ("published", "updated")), "sitemap": ("url", "loc", ("lastmod",))}


def _text(item: str, tag: str) -> str:
    found = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", item, re.S | re.I)
    bare = re.sub(r"^\s*<!\[CDATA\[(.*)\]\]>\s*$", r"\1", found[1], flags=re.S) if found else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", bare)).split())


def entries(document: str, most: int) -> Iterator[tuple[str, int, str, str, str]]:
    """kind, place, url, title and published of a document's items; an error for what is no feed."""
    root = re.search(r"<(rss|rdf:RDF|feed|urlset)\b", document, re.I)
    if not root or f"</{root[1]}" not in document:
        raise ValueError("no whole feed")
    kind = {"feed": "atom", "urlset": "sitemap"}.get(root[1].lower(), "rss")
    name, address, times = ITEMS[kind]
    for at, item in enumerate(re.findall(rf"<{name}\b[^>]*>(.*?)</{name}>", document, re.S | re.I)[:most]):
        link = re.search(r"<link\b[^>]*\bhref\s*=\s*[\"']([^\"']*)", item, re.I) if kind == "atom" else None
        url = html.unescape(link[1]) if link else _text(item, address)
        yield kind, at, url, _text(item, "title"), next((t for t in (_text(item, x) for x in times) if t), "")


class Feed(InputPartition):
    def __init__(self, source: str, folder: str):
        super().__init__(source)
        self.source, self.folder = source, folder


class FeedReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder.removeprefix("file:"), most
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list) -> Iterator:
        """Conditions on the source alone are decided by the listing; others go back to Spark."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("source",):
                self.wanted = set(values) if self.wanted is None else self.wanted & set(values)
            else:
                yield f

    def partitions(self) -> list[Feed]:
        found = sorted(d for d in os.listdir(self.folder) if d.startswith("source="))
        named = [(unquote(d.removeprefix("source=")), f"{self.folder}/{d}") for d in found]
        return [Feed(name, where) for name, where in named if self.wanted is None or name in self.wanted]

    def read(self, partition: Feed) -> Iterator[tuple]:
        names = sorted(x for x in os.listdir(partition.folder) if not x.startswith((".", "_")))
        text = []
        for x in names:
            with open(f"{partition.folder}/{x}", encoding="utf-8", errors="replace") as f:
                text.append(f.read())
        try:
            for kind, at, url, title, published in entries("".join(text), self.most):
                yield partition.source, kind, at, url, title, published, None
        except ValueError as e:
            yield partition.source, None, None, None, None, None, str(e)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options["path"], int(self.options.get("most", 50)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)


def folder_of(root: str, source: str) -> str:
    """Where a feed's document belongs."""
    return f"{root}/source={quote(source, safe='')}"
