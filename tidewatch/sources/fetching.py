"""Pages over HTTP as a Python data source, with retries, access routing and charset detection.

    spark.dataSource.register(fetching.PageSource)
    spark.read.format("pages").option("urls", "https://a/1 https://a/2").option("access", "direct").load()

Each address is one input partition. A source that stays unavailable, or whose access can't be used, gives a row with
ok = false, so the others go on. Nothing is fetched unless a query asks for it.
"""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ATTEMPTS, TIMEOUT = 3, 15
LEAST_WAIT, MOST_WAIT = 1, 10
AGENT = "Mozilla/5.0 (compatible; publication monitor)"


class SourceUnavailable(Exception):
    """All attempts failed."""


def decode(content: bytes | None, declared: str | None) -> str | None:
    """By the declared charset, else a detected one, else UTF-8 with replacements."""
    if content is None:
        return None
    if declared:
        try:
            return content.decode(declared)
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return content.decode("utf-8", "replace")
    best = from_bytes(content).best()
    return str(best) if best is not None else content.decode("utf-8", "replace")


def decoded(content: Column, declared: Column) -> Column:
    """decode() over columns; the built-in decoder lacks the Cyrillic code page."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(raw: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([decode(bytes(r) if r is not None else None, n) for r, n in zip(raw, names, strict=True)], dtype=object)

    return run(content, declared)


def routed(access: str, proxy: str | None) -> dict[str, str]:
    """Proxies for an access mode; modes that can't be used are errors, and never retried."""
    if access == "direct":
        return {}
    if access == "ru_proxy":
        if not proxy:
            raise ValueError("access ru_proxy needs a proxy address")
        return {"http": proxy, "https": proxy}
    raise ValueError(f"access {access!r} can't be fetched")


def with_retries(get: Callable[[], tuple], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """Retries transport errors (answers cut short as well) and any HTTP error status, with exponential waits."""
    for k in range(attempts):
        try:
            return get()
        except (urllib.error.URLError, http.client.HTTPException, OSError) as error:
            if k == attempts - 1:
                raise SourceUnavailable(str(error)) from error
            sleep(min(MOST_WAIT, LEAST_WAIT * 2**k))
    raise SourceUnavailable("no attempts")


def fetch(url: str, access: str = "direct", proxy: str | None = None) -> tuple[int, str | None, str]:
    """Status, content type and text."""
    opener = urllib.request.build_opener(urllib.request.ProxyHandler(routed(access, proxy)))

    def get() -> tuple[int, str | None, str]:
        request = urllib.request.Request(url, headers={"User-Agent": AGENT})
        with opener.open(request, timeout=TIMEOUT) as answer:
            return answer.status, answer.headers.get("Content-Type"), decode(answer.read(), answer.headers.get_content_charset())

    return with_retries(get)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, ok boolean, status int, content_type string, html string, error string"

    def reader(self, schema) -> "PageReader":
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.urls = (options.get("urls") or "").split()
        self.access, self.proxy = options.get("access", "direct"), options.get("proxy")

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        if partition is None:  # no addresses
            return
        try:
            status, kind, text = fetch(partition.value, self.access, self.proxy)
            yield partition.value, True, status, kind, text, None
        except Exception as error:  # whatever is wrong with one page, the others are read
            yield partition.value, False, None, None, None, f"{type(error).__name__}: {error}"


def fetched(spark: SparkSession, wanted: list[tuple[str, str]], proxy: str | None = None) -> DataFrame:
    """url, ok, html, error of (address, access) pairs; each address once."""
    spark.dataSource.register(PageSource)
    out = None
    for access in sorted({a for _, a in wanted}) or ["direct"]:
        reader = spark.read.format("pages").option("urls", " ".join(sorted({u for u, a in wanted if a == access}))).option("access", access)
        rows = (reader.option("proxy", proxy) if proxy else reader).load()
        out = rows if out is None else out.unionByName(rows)
    return out.select("url", "ok", "html", "error")
