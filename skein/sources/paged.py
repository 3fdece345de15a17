"""Saved pages of a harvest as a streaming source, whose offset is the resumption token.

    spark.dataSource.register(PagedHarvest)
    spark.readStream.format("paged_harvest").load("file:///pages")

A folder holds the answers of a list as they came: `first.xml`, then `<token>.xml` for each token that a page ends with. A page is there once a harvester has written it whole (under another name, and renamed). The
stream goes from page to page as far as there are any, and takes up again at the token after the last page of a finished batch, whatever was added meanwhile.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: The name of the first page, which has no token, and the offset after a list's last page.
FIRST, END = "first", "end of list"


def page_name(token: str) -> str:
    """A token as a file's name."""
    return urllib.parse.quote(token, safe="") + ".xml"


def _read(folder: str, token: str) -> str | None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    at = f"{path.rstrip('/')}/{page_name(token)}"
    if where.get_file_info(at).type != fs.FileType.File:
        return None
    with where.open_input_stream(at) as f:
        return f.read().decode()


def next_token(page: str) -> str | None:
    """What the page's resumptionToken holds; None if it holds nothing or there is none."""
    import html

    found = re.search(r"<resumptionToken[^>]*>([^<]*)</resumptionToken>", page)
    return html.unescape(found.group(1)).strip() or None if found else None


class _Page(InputPartition):
    def __init__(self, token: str, following: str | None):
        self.token, self.following = token, following


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.at = folder, most, FIRST

    def initialOffset(self) -> dict:
        return {"token": FIRST}

    def _walk(self, token: str, until: str | None = None) -> Iterator[tuple[str, str]]:
        """Pages from a token on, with the token after each, as far as they are there, or up to a token."""
        for _ in range(self.most):
            page = None if token in (until, END) else _read(self.folder, token)
            if page is None:
                return
            following = next_token(page) or END
            yield token, following
            token = following

    def latestOffset(self) -> dict:
        for _, self.at in self._walk(self.at):
            pass
        return {"token": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        self.at = end["token"]  # also of a batch planned before a restart: the next one goes on from it
        return [_Page(token, following) for token, following in self._walk(start["token"], end["token"])]

    def read(self, partition: _Page) -> Iterator[tuple]:
        yield partition.token, partition.following if partition.following != END else None, _read(self.folder, partition.token)

    def commit(self, end: dict) -> None:
        pass


class PagedHarvest(DataSource):
    """Rows token, next (null on a list's last page), xml: a page each, of which `sources.readers.parse_oai_page` makes records. Option pages: the most pages of one batch (1000)."""

    @classmethod
    def name(cls) -> str:
        return "paged_harvest"

    def schema(self) -> str:
        return "token string, next string, xml string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("pages", "1000")))
