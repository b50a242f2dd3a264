"""Pages: links, titles, tables, and which addresses are worth a look (H-01 to H-06, S-09)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.session import ship

# File suffixes that are never taken for data.
SKIPPED_SUFFIXES = ["pdf", "zip", "tar", "gz", "jpg", "jpeg", "png", "img", "gif", "doc", "docx", "ppt", "pptx", "mp3", "mp4", "avi", "wmv", "flv", "3gp", "svg", "dxf", "psd", "php", "html"]
# Words of a link's text that make it no title, besides those suffixes.
DULL_WORDS = ["excel", "csv", "file", "download", "table", "data", "save", "click", "index"]
# Fixed value: the pattern of addresses that are taken.
URL = r"(?i)^(?:http|ftp)s?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+(?:[A-Z]{2,6}\.?|[A-Z0-9-]{2,}\.?)|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"


def url_valid(url: Column) -> Column:
    return F.coalesce(url.rlike(URL), F.lit(False))


def suffix(url: Column) -> Column:
    """The lower-cased end of the last part of an address after its last dot, up to a hash; '' without one."""
    return F.lower(F.regexp_extract(url, r"\.([^./#]*)(?:#[^/]*)?$", 1))


def looks_like_data(url: Column) -> Column:
    return ~suffix(url).isin(SKIPPED_SUFFIXES)


def dull_title(text: Column) -> Column:
    """Whether a link's text has a word that makes it no title."""
    return F.arrays_overlap(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, DULL_WORDS + SKIPPED_SUFFIXES)))


def _decoded(text: Column) -> Column:
    """The character references that titles use decoded, the ampersand's last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def title(html: Column) -> Column:
    return F.trim(_decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def description(html: Column) -> Column:
    """Title and meta description, one a line; a meta tag's attributes may stand in any order."""
    meta = r"""(?is)<meta\s(?=[^>]*(?<=\s)name\s*=\s*["']?description(?=["'\s/>]))[^>]*?(?<=\s)content\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    said = _decoded(F.concat(F.regexp_extract(html, meta, 1), F.regexp_extract(html, meta, 2)))
    return F.concat_ws("\n", *(F.when(F.trim(x) != "", F.trim(x)) for x in (title(html), said)))


class _Links(HTMLParser):
    """Links wherever they stand: what no <body> tag encloses belongs to a body that parsers supply."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def end(self) -> None:
        if self.href is not None:
            self.found.append(("".join(self.text).strip(), self.href))
            self.href = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.end()  # links don't nest
            given = dict(attrs)
            self.href, self.text = (given["href"] or "") if "href" in given else None, []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a":
            self.end()


def parse_links(page: str, url: str | None) -> list[tuple[str, str]]:
    """(text, address) of a page's links; those that don't begin with http or ftp need the page's address and are left out without it."""
    from urllib.parse import urljoin

    p = _Links()
    p.feed(page or "")
    p.close()
    p.end()
    out = []
    for text, href in p.found:
        if href.startswith(("http", "ftp")):
            out.append((text, href))
        elif url:
            try:
                out.append((text, urljoin(url, href)))
            except ValueError:
                continue
    return out


def loaded(sources: DataFrame, key: str = "page_id", source: str = "source", answers: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """H-06: (key, url, html) of pages given as an address, a file or text.

    A source that begins like an address and is one becomes the page's ``url``, its text is the body of ``answers`` (url, body), of several the
    least, null without one: fetching is the caller's. One that ends in .html is the file of that path below ``folder``, or text if there is none. Anything else is the page itself.
    """
    given = F.col(source)
    rows = sources.select(F.col(key), given.alias("_source"), F.coalesce(given.rlike("^(http|ftp)") & url_valid(given), F.lit(False)).alias("_is_url"))
    if answers is None:
        rows = rows.withColumn("_body", F.lit(None).cast("string"))
    else:
        bodies = answers.groupBy(F.col("url").alias("_url")).agg(F.min("body").alias("_body"))
        rows = rows.join(bodies, F.col("_is_url") & (F.col("_source") == F.col("_url")), "left")
    if folder is None:
        rows = rows.withColumn("_content", F.lit(None).cast("string"))
    else:
        files = sources.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").load(folder)
        path = lambda c: F.regexp_replace(c, "^file:/*", "/")
        files = files.select(path(F.col("path")).alias("_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("_content"))
        rows = rows.join(files, ~F.col("_is_url") & F.col("_source").endswith(".html") & (path(F.col("_source")) == F.col("_path")), "left")
    url = F.when(F.col("_is_url"), F.col("_source"))
    return rows.select(key, url.alias("url"), F.when(F.col("_is_url"), F.col("_body")).otherwise(F.coalesce("_content", "_source")).alias("html"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, text, href) of every link, parsed within Arrow batches: a regular expression can't nest tags."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, t, h) for k, page, u in zip(f[key], f[html], f[url]) for t, h in parse_links(page, u)]
            yield pd.DataFrame(rows, columns=[key, "text", "href"])

    ship(pages.sparkSession)
    return pages.select(key, html, url).mapInPandas(run, f"{key} {kind}, text string, href string")


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.marks: list[dict[str, str | None]] = []
        self.headed: list[bool] = []
        self.depth: list[int] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.marks.append(dict(attrs))
            self.headed.append(False)
            self.depth.append(len(self.tables) - 1)
        elif self.depth:
            now = self.tables[self.depth[-1]]
            if tag == "tr":
                now.append([])
            elif tag in ("td", "th"):
                if not now:
                    now.append([])
                if len(now) == 1 and not now[0]:
                    self.headed[self.depth[-1]] = tag == "th"
                self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.depth:
            self.tables[self.depth[-1]][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.depth:
            self.depth.pop()


_XPATH = re.compile(r"//table(?:\[(\d+)\]|\[@([\w-]+)=(['\"])(.*?)\3\])?")


def chooses(selector: str | None, index: int, marks: dict[str, str | None]) -> bool:
    """Whether a table is the chosen one: by place from 0 ("2"), "#id", ".class", or //table with a place from 1 or an attribute; None chooses all.

    Another selector raises ValueError.
    """
    if selector is None or selector == "":
        return True
    if selector.isdigit():
        return index == int(selector)
    if selector[0] == "#":
        return marks.get("id") == selector[1:]
    if selector[0] == ".":
        return selector[1:] in (marks.get("class") or "").split()
    m = _XPATH.fullmatch(selector)
    if not m:
        raise ValueError(f"no selector of tables: {selector}")
    place, name, _, value = m.groups()
    return index == int(place) - 1 if place else name is None or marks.get(name) == value


def parse_tables(page: str, selector: str | None = None) -> Iterator[tuple[int, list[list[str]], bool]]:
    """(index, rows, whether the first row names the columns) of the chosen tables of a page; rows without cells are left out."""
    p = _Tables()
    p.feed(page or "")
    for i, rows in enumerate(p.tables):
        if chooses(selector, i, p.marks[i]):
            yield i, [r for r in rows if r], p.headed[i]


@F.udtf(returnType="table int, row int, header boolean, cells array<string>")
class PageTables:
    """S-09, S-18: the rows of a page's tables, for lateral joins: ``page_tables(html, selector)`` in SQL, once registered."""

    def eval(self, page: str, selector: str | None):
        for i, rows, headed in parse_tables(page, selector):
            for j, cells in enumerate(rows):
                yield i, j, headed and j == 0, cells


def register(spark: SparkSession) -> None:
    """Makes ``page_tables`` known to SQL."""
    ship(spark)
    spark.udtf.register("page_tables", PageTables)


def tables(pages: DataFrame, key: str = "page_id", html: str = "html", selector: str | None = None) -> DataFrame:
    """S-09, S-18: (key, table, row, header, cells) of the chosen tables of all pages; tables and rows are counted from 0."""
    ship(pages.sparkSession)
    rows = PageTables(F.col(html).outer(), F.lit(selector).cast("string"))
    return pages.select(key, html).lateralJoin(rows).select(key, "table", "row", "header", "cells")
