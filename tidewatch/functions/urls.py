"""Hosts, allowed domains, content types and links."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
# Content types that hold text.
TEXT_TYPES = ("text/html", "text/plain", "application/xhtml+xml", "application/pdf")


def host(url: Column) -> Column:
    """The lower-case host without port and user; empty where there is no scheme."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def suffixes(name: Column) -> Column:
    """a.b.c as a.b.c, b.c, c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def allowed(rows: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is a domain of the list or below one: an equi-join on suffixes, not a theta join.

    domains: one column ``domain``, distinct. A host meets a domain at most once per suffix, and rows are kept once
    by collecting the matches per host.
    """
    hosts = rows.select(host(F.col(url)).alias("host")).distinct().where("host <> ''")
    good = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain")).join(domains, "domain", "left_semi").select("host").distinct()
    return rows.withColumn("host", host(F.col(url))).join(good, "host", "left_semi")


def is_allowed(url: Column, domains: list[str]) -> Column:
    """The same as an expression, for a short list."""
    return F.arrays_overlap(suffixes(host(url)), F.array(*[F.lit(d) for d in domains])) & (host(url) != "")


def is_text(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))).isin(*TEXT_TYPES), F.lit(False))


def resolve(base: str, href: Column) -> Column:
    """A link against its page: absolute and root-relative links as expressions, the rest by the RFC's rules."""
    origin = "/".join(base.split("/")[:3])

    @F.pandas_udf("string")
    def general(links: pd.Series) -> pd.Series:
        return links.map(lambda x: None if x is None else urljoin(base, x))

    return F.when(href.rlike("^https?://"), href).when(href.startswith("/") & ~href.startswith("//"), F.concat(F.lit(origin), href)).otherwise(general(href))


def source_domain(source_key: Column) -> Column:
    return F.split_part(source_key, F.lit("/"), F.lit(1))


def link_ok(link: Column) -> Column:
    """What an expert may answer: a link, or 'skip' in any case."""
    return link.startswith("http") | (F.lower(link) == "skip")


def id_ok(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def allow_list(ids: Column) -> Column:
    """'1, 2,,3' as numbers."""
    return F.transform(F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("bigint"))


def label(code: Column, labels: dict[str, str], missing: str | None = None) -> Column:
    """The code's label, else the code itself; null becomes ``missing``."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), code)
    out = F.coalesce(found, code)
    return F.coalesce(out, F.lit(missing)) if missing is not None else out


def page_text(layer: Column, recognised: Column, least: int = 20) -> Column:
    """A page's text layer, or what recognition gives where the layer is shorter than ``least``."""
    trimmed = F.trim(F.coalesce(layer, F.lit("")))
    return F.when(F.length(trimmed) < least, F.trim(F.coalesce(recognised, F.lit("")))).otherwise(trimmed)
