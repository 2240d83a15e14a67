"""Listing pages to publications: one tolerant HTML reader driven by a description of each site."""

from __future__ import annotations

import html.parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates
from tidewatch.functions.urls import resolve

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element: tag, attributes, children (elements and strings)."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def parts(self) -> Iterator["Node | str"]:
        """All that lies below, in document order; without recursion, as pages may nest elements thousands deep."""
        left = self.children[::-1]
        while left:
            x = left.pop()
            yield x
            if isinstance(x, Node):
                left.extend(reversed(x.children))

    def walk(self) -> Iterator["Node"]:
        return (x for x in self.parts() if isinstance(x, Node))

    def strings(self) -> Iterator[str]:
        return (x for x in self.parts() if not isinstance(x, Node))

    def text(self, joint: str = "") -> str:
        return joint.join(s for s in (p.strip() for p in self.strings()) if s)

    def matches(self, want: str) -> bool:
        """tag.class, tag[attr=value], tag[attr*=value]; the tag may be missing."""
        head, _, test = want.partition("[")
        tag, _, name = head.partition(".")
        if tag and tag != self.tag:
            return False
        if name and name not in self.attrs.get("class", "").split():
            return False
        if test:
            key, _, value = test.rstrip("]").partition("=")
            value = value.strip('"')
            if key.endswith("*"):
                return value in self.attrs.get(key[:-1], "")
            return self.attrs.get(key) == value
        return True

    def find_all(self, path: str) -> list["Node"]:
        """Descendants by a path of steps; '>' asks for children. In document order, each once."""
        found, direct = [self], False
        for step in path.split():
            if step == ">":
                direct = True
                continue
            seen: dict[int, Node] = {}
            for node in found:
                inside = [x for x in node.children if isinstance(x, Node)] if direct else node.walk()
                seen |= {id(x): x for x in inside if x.matches(step)}
            found, direct = list(seen.values()), False
        return found

    def find(self, path: str) -> "Node | None":
        return next(iter(self.find_all(path)), None)


class Reader(html.parser.HTMLParser):
    """Builds the tree; unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(text: str | None) -> Node:
    reader = Reader()
    reader.feed(text or "")
    reader.close()
    return reader.root


@dataclass(frozen=True)
class Site:
    """Where a listing keeps its fields. ``date`` names how its dates are read."""

    key: str
    base: str
    card: str
    link: str
    title: str
    date: str
    date_node: str | None = None
    date_attr: str | None = None
    summary: str | None = None
    title_joint: str = ""
    first: str = ""
    pages: str = ""
    access: str = "direct"
    label: str | None = None


# Markup and addresses of the monitored listings.
SITES = {
    s.key: s
    for s in (
        Site("sfr.gov.ru/press_center/news", "https://sfr.gov.ru", "article.re-news__article", "a.re-news__article-link", "h3.re-news__article-title", "iso", "time.re-news__article-time", "datetime", "p.re-news__article-description", first="https://sfr.gov.ru/press_center/news/", pages="https://sfr.gov.ru/press_center/news/?page={page}"),
        Site("mintrud.gov.ru/docs", "https://mintrud.gov.ru", "div.post-list", "a.text-black", "p.post-name", "russian", "p.page-date", first="https://mintrud.gov.ru/docs", pages="https://mintrud.gov.ru/docs?directoryId=128&page={page}"),
        Site("msupport.dszn.ru/news", "https://msupport.dszn.ru", "a[href*=dszn.ru/press-center/news/]", "", "p b", "russian", "span.date", first="https://msupport.dszn.ru/news", pages="https://msupport.dszn.ru/news/page-{page}"),
        Site("publication.pravo.gov.ru", "http://publication.pravo.gov.ru", ".documents-table-row", "a.documents-item-name", "a.documents-item-name", "dotted", ".infoindocumentlist > div", title_joint=" ", first="http://publication.pravo.gov.ru/Documents/search?block=&periodType=daily&category=&index=1", pages="http://publication.pravo.gov.ru/Documents/search?block=&periodType=daily&category=&index={page}", access="ru_proxy", label="Дата"),
        Site("kremlin.ru/acts/news", "http://www.kremlin.ru", "div[itemtype=http://schema.org/NewsArticle]", "a[itemprop=url]", "span[itemprop=name]", "iso", "time[itemprop=datePublished]", "datetime", first="http://www.kremlin.ru/acts/news", pages="http://www.kremlin.ru/acts/news/page/{page}", access="ru_proxy"),
        Site("government.ru/docs", "http://government.ru", "div.headline", "a.headline__link", "span.headline_title_link", "iso", "span.headline_date time", "datetime", "span.headline_lead", first="http://government.ru/docs/", pages="http://government.ru/docs/?page={page}", access="ru_proxy"),
    )
}


def cards(site: Site, text: str | None) -> list[tuple]:
    """(ord, href, title, raw_date, summary) of a page; cards without a link or a title element are skipped."""
    out = []
    for card in tree(text).find_all(site.card):
        link = card.find(site.link) if site.link else card
        title = card.find(site.title)
        if link is None or title is None or not link.attrs.get("href"):
            continue
        raw = None
        if site.label:
            for row in card.find_all(site.date_node):
                name, data = row.find(".info-name"), row.find(".info-data")
                if name is not None and data is not None and site.label in name.text():
                    raw = data.text()
                    break
        elif site.date_node and (node := card.find(site.date_node)) is not None:
            raw = node.attrs.get(site.date_attr) if site.date_attr else "".join(node.strings())
        summary = card.find(site.summary) if site.summary else None
        out.append((len(out), link.attrs["href"], title.text(site.title_joint), raw or None, summary.text() if summary is not None else None))
    return out


def published(site: Site, raw: Column) -> Column:
    if site.date == "iso":
        return dates.iso_moscow(raw)
    if site.date == "dotted":
        return dates.dotted_moscow(raw)
    return dates.russian_date(raw).cast("timestamp")


def read_pages(pages: DataFrame, site: Site) -> DataFrame:
    """Publications of captured pages (page, html): source_key, page, ord, title, url, published_at, summary, error.

    A page that the reader rejects is one row with an error and nothing else; the other pages are read.
    """

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for page, text in zip(batch["page"].tolist(), batch["html"].tolist(), strict=True):
                try:
                    rows += [(page, *card, None) for card in cards(site, text)]
                except Exception as failed:  # the parser's own errors: bad markup, too deep nesting
                    rows.append((page, None, None, None, None, None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["page", "ord", "href", "title", "raw_date", "summary", "error"]).astype({"ord": "Int32"})

    found = pages.select(F.col("page").cast("int"), "html").mapInPandas(run, "page int, ord int, href string, title string, raw_date string, summary string, error string")
    url = F.col("href") if site.link == "" else resolve(site.base, F.col("href"))
    return found.select(F.lit(site.key).alias("source_key"), "page", "ord", "title", url.alias("url"), published(site, F.col("raw_date")).alias("published_at"), "summary", "error")


def read_listing(pages: DataFrame, site: Site) -> DataFrame:
    """The publications of the pages that can be read."""
    return read_pages(pages, site).where("error IS NULL").drop("error")


# The document register keeps its listing as JSON inside the page.
REGISTER = "mos.ru/authority/documents"
REGISTER_URL = "https://www.mos.ru/authority/documents/"
_ISLAND = r"""(?s)<script(?=[^>]*\bid=["']__NEXT_DATA__["'])(?=[^>]*\btype=["']application/json["'])[^>]*>(.*?)</script>"""
_SHAPE = "struct<props:struct<pageProps:struct<initialState:struct<documentsList:struct<data:array<struct<id:string,title:string,date_published:string>>>>>>>"


def read_register(pages: DataFrame) -> DataFrame:
    """Publications of the register's pages; pages without the block or its keys give none."""
    island = F.from_json(F.regexp_extract("html", _ISLAND, 1), _SHAPE)
    items = pages.select(F.col("page").cast("int").alias("page"), F.posexplode(island["props"]["pageProps"]["initialState"]["documentsList"]["data"]).alias("ord", "d"))
    title = F.regexp_replace(F.col("d.title"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return items.where(F.col("d.id").isNotNull() & (F.coalesce(title, F.lit("")) != "")).select(
        F.lit(REGISTER).alias("source_key"), "page", "ord", title.alias("title"), F.concat(F.lit(REGISTER_URL + "doc/"), F.col("d.id"), F.lit("/")).alias("url"), dates.moscow_stamp(F.col("d.date_published")).alias("published_at"), F.lit(None).cast("string").alias("summary")
    )


def broken_register(html: Column) -> Column:
    """Whether a page has the block, but not as JSON: such a page is a failure, not an empty one."""
    island = F.regexp_extract(html, _ISLAND, 1)
    return (F.trim(island) != "") & F.try_parse_json(island).isNull()


# Feeds of the context sources.
FEEDS = {
    "garant.ru": "https://rss.garant.ru/news/",
    "consultant.ru": "https://www.consultant.ru/rss/hotdocs.xml",
    "tass.ru": "https://tass.ru/rss/v2.xml",
    "ria.ru": "https://ria.ru/export/rss2/index.xml",
    "rg.ru": "https://rg.ru/xml/index.xml",
}
_RSS = "channel struct<item: array<struct<title: string, link: string, pubDate: string, description: string>>>"


_ITEM = r"(?is)<item\b[^>]*>((?:(?!<item\b).)*?)(?:</item\s*>|(?=<item\b)|$)"


def _field(item: Column, name: str) -> Column:
    """An element's text: whole CDATA as it stands, else with the five named entities read, and without tags unless a part is CDATA."""
    inner = F.regexp_extract(item, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    data = F.regexp_extract(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    plain = F.when(inner.contains("<![CDATA["), F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")).otherwise(F.regexp_replace(inner, r"<[^>]*>", ""))
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(mark))
    return F.nullif(F.trim(F.when(data != "", data).otherwise(plain)), F.lit(""))


def loose_items(xml: Column) -> Column:
    """The items of a feed that isn't well-formed, as far as they can be found."""
    return F.transform(F.regexp_extract_all(xml, F.lit(_ITEM), F.lit(1)), lambda i: F.struct(*[_field(i, n).alias(n) for n in ("title", "link", "pubDate", "description")]))


def read_feed(pages: DataFrame, domain: str) -> DataFrame:
    """Publications of a captured feed (column xml); one page, in feed order.

    A feed that isn't well-formed is read as far as its items can be found: it counts as read, as feed readers do.
    """
    if domain not in FEEDS:
        raise ValueError(f"no feed for {domain!r}; there are {', '.join(sorted(FEEDS))}")
    items = pages.select("xml", F.from_xml("xml", _RSS).alias("x")).select(F.posexplode(F.coalesce("x.channel.item", loose_items(F.col("xml")))).alias("ord", "i"))
    return items.where((F.coalesce("i.link", F.lit("")) != "") & (F.coalesce("i.title", F.lit("")) != "")).select(
        F.lit(domain).alias("source_key"), F.lit(1).alias("page"), "ord", F.col("i.title").alias("title"), F.col("i.link").alias("url"), dates.feed_date(F.col("i.pubDate")).alias("published_at"), F.when(F.col("i.description") != "", F.col("i.description")).alias("summary")
    )


def read_all_feeds(pages: DataFrame) -> DataFrame:
    """All feeds of (domain, ok, xml): a feed that could not be read gives no rows, the others go on."""
    good = pages.where(F.coalesce("ok", F.lit(False)))
    out = None
    for domain in FEEDS:
        rows = read_feed(good.where(F.col("domain") == domain), domain)
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class Listing:
    """A source of a run: where its pages are, how they are reached, and what reads them.

    ``pages`` is the pattern of the pages after the first, empty for a source of one page. ``read`` takes (page, html) and gives
    publications, and where it has a column ``error``, rows of pages that it rejects; ``broken`` tells of a page that was fetched whether it is none of the source's pages.
    """

    key: str
    first: str
    pages: str
    access: str
    read: Callable[[DataFrame], DataFrame]
    broken: Callable[[Column], Column] = lambda html: F.lit(False)


def registry() -> list[Listing]:
    """All sources in the order of a run."""

    def site(key: str) -> Listing:
        s = SITES[key]
        return Listing(key, s.first, s.pages, s.access, lambda pages: read_pages(pages, s))

    def feed(domain: str) -> Listing:
        return Listing(domain, FEEDS[domain], "", "direct", lambda pages: read_feed(pages.select(F.col("html").alias("xml")), domain))

    register = Listing(REGISTER, REGISTER_URL, REGISTER_URL + "?page={page}", "direct", read_register, broken_register)
    federal, other = ["sfr.gov.ru/press_center/news", "mintrud.gov.ru/docs"], ["msupport.dszn.ru/news", "publication.pravo.gov.ru", "kremlin.ru/acts/news", "government.ru/docs"]
    return [*map(site, federal), register, *map(site, other), *map(feed, FEEDS)]


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)
