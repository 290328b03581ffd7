"""A paged REST source of releases: next-page links are followed until there is none.

Page n + 1 is known only from page n, so a read is one task; the rows are few.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from quillspark import schema
from quillspark.functions.coerce import uri_component

# Address, page size, headers and link form of the public API.
API_ROOT = "https://api.github.com"
PAGE_SIZE = 100
_NEXT = re.compile(r'<([^>]+)>;\s*rel="next"', re.IGNORECASE)

#: ``(url, headers) -> (status, Link header, body)``
Fetch = Callable[[str, dict[str, str]], tuple[int, str, str]]


def check_repository(spec: str | None) -> tuple[str, str]:
    """``owner/name``: both there, and nothing but an empty third part."""
    owner, name, extra = [*(spec or "").split("/"), "", "", ""][:3]
    if not owner or not name or extra:
        raise ValueError("repository must have the form owner/name")
    return owner, name


def headers(token: str = "") -> dict[str, str]:
    out = {"Accept": "application/vnd.github+json", "User-Agent": "quillspark", "X-GitHub-Api-Version": "2022-11-28"}
    return out | {"Authorization": f"Bearer {token}"} if token else out


def next_url(link: str | None) -> str:
    found = _NEXT.search(link or "")
    return found[1] if found else ""


def http_fetch(url: str, sent: dict[str, str]) -> tuple[int, str, str]:
    try:
        with urlopen(Request(url, headers=sent), timeout=60) as answer:
            return answer.status, answer.headers.get("link") or "", answer.read().decode()
    except HTTPError as e:
        return e.code, "", e.read().decode(errors="replace")


def fetch_pages(repository: str, token: str = "", fetch: Fetch = http_fetch, root: str = API_ROOT) -> Iterator[dict]:
    """All releases in API order. An error status or a body that is no array ends the read."""
    owner, name = map(uri_component, check_repository(repository))
    url = f"{root}/repos/{owner}/{name}/releases?per_page={PAGE_SIZE}&page=1"
    while url:
        status, link, body = fetch(url, headers(token))
        if not 200 <= status < 300:
            raise RuntimeError(f"releases API returned {status}: {body[:500]}")
        page = json.loads(body)
        if not isinstance(page, list):
            raise RuntimeError("releases API returned no array")
        yield from page
        url = next_url(link)


_TEXT = ("size", "download_count")


def _row(ordinal: int, release: dict) -> tuple:
    """A release as a row of ``RAW_RELEASES``; numbers that are coerced later stay text."""
    def asset(a: dict) -> tuple:
        return tuple(None if a.get(f) is None else str(a[f]) if f in _TEXT else a[f] for f in schema.RAW_RELEASES["assets"].dataType.elementType.names)

    assets = release.get("assets")
    return (*[release.get(f) for f in schema.RAW_RELEASES.names[:-1]], None if assets is None else [asset(a) for a in assets], ordinal)


class ReleasesSource(DataSource):
    """``spark.read.format("releases").option("repository", "owner/name").load()``.

    The token is an option; data source options stay out of plan strings.
    """

    @classmethod
    def name(cls) -> str:
        return "releases"

    def schema(self) -> StructType:
        return StructType([*schema.RAW_RELEASES.fields, StructField("ordinal", LongType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        check_repository(options.get("repository"))
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        pages = fetch_pages(self.options["repository"], self.options.get("token", ""), http_fetch, self.options.get("root", API_ROOT))
        for k, release in enumerate(pages):
            yield _row(k, release)


def read_api(spark: SparkSession, repository: str, token: str = "", fetch: Fetch | None = None) -> DataFrame:
    """Releases from the API; a given ``fetch`` is called on the driver, for tests and other transports."""
    if fetch is not None:
        rows = [_row(k, r) for k, r in enumerate(fetch_pages(repository, token, fetch))]
        return spark.createDataFrame(rows, StructType([*schema.RAW_RELEASES.fields, StructField("ordinal", LongType())]))
    spark.dataSource.register(ReleasesSource)
    return spark.read.format("releases").option("repository", repository).option("token", token).load()
