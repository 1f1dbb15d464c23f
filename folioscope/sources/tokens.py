"""Records behind a continuation token: each page names the next, and nobody knows beforehand how many there are.

As a stream, the offset is the token: a micro-batch reads the next ``pages`` pages of every query and ends at the token they
lead to. Tokens are in the stream's checkpoint, so after a failure only pages of a batch that was not finished are asked for
again. As a batch, a query is a partition that follows its tokens to the end. Failed requests are tried again after pauses
that double.

Options: url (``{query}`` and ``{token}`` are filled in; the first token is empty), queries (comma-separated), pages (for
each query in a micro-batch), records and next (names of the page's list and token), retries and pause (seconds).
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Answers that may be better next time.
PASSING = (408, 425, 429, 500, 502, 503, 504)


class Pages:
    """Fetches pages: token -> (records, next token or None)."""

    def __init__(self, options):
        self.url = options["url"]
        self.records, self.next = options.get("records", "records"), options.get("next", "next")
        self.retries, self.pause = int(options.get("retries", "5")), float(options.get("pause", "0.5"))

    def fetch(self, query: str, token: str) -> tuple[list, str | None]:
        quote = urllib.parse.quote
        url = self.url.replace("{query}", quote(query, safe="")).replace("{token}", quote(token, safe=""))
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:
                    page = json.load(answer)
                return page.get(self.records) or [], page.get(self.next) or None
            except urllib.error.HTTPError as e:
                if e.code not in PASSING or attempt == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if attempt == self.retries:
                    raise
            time.sleep(self.pause * 2**attempt)
        raise AssertionError("unreachable")

    def follow(self, query: str, token: str, most: int | None = None, until: str | None = None) -> Iterator[tuple[list, str | None]]:
        """(rows, next token) of page after page: up to ``most`` pages, or to the one that leads to the token ``until``."""
        done = 0
        while True:
            records, following = self.fetch(query, token)
            yield [(query, token, json.dumps(r, ensure_ascii=False)) for r in records], following
            done += 1
            if following is None or done == most or (until is not None and following == until):
                return
            token = following


class TokenSource(DataSource):
    """Format ``token_pages``: query, token (that of the record's page) and value (the record as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "token_pages"

    def schema(self) -> str:
        return "query string, token string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def _queries(options) -> list[str]:
    return [q for q in options.get("queries", "").split(",") if q]


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.pages, self.queries = Pages(options), _queries(options)

    def partitions(self):
        return [_Query(q) for q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        for rows, _ in self.pages.follow(partition.query, ""):
            yield from rows


class _Stream(SimpleDataSourceStreamReader):
    """Offset: query -> the token of its next page; null when there is none."""

    def __init__(self, options):
        self.pages, self.queries, self.most = Pages(options), _queries(options), int(options.get("pages", "1"))

    def initialOffset(self) -> dict:
        return {q: "" for q in self.queries}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for query, token in start.items():
            if token is not None:
                for page, end[query] in self.pages.follow(query, token, self.most):
                    rows += page
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for query, token in start.items():
            if token is not None and end[query] != token:
                for page, _ in self.pages.follow(query, token, until=end[query]):
                    yield from page
