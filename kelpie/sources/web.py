"""Pages of the web as rows, by a fetcher that tests replace."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.shared import find_package
from kelpie.sources import html

#: Fetches a page by its URL and how often its button for more was pressed.
Fetch = Callable[[str, int], str]


def fetch_url(url: str, pressed: int = 0, timeout: float = 60.0) -> str:
    """A page over HTTP; a button is pressed by the query parameter p, as listings without scripts have it."""
    if pressed:
        url += ("&" if "?" in url else "?") + f"p={pressed + 1}"
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def pages(urls: DataFrame, fetch: Fetch = fetch_url, pause: float = 0.0, tries: int = 2) -> DataFrame:
    """Rows (url, html, error) for urls (url), each fetched where its row is; a page that fails has no html."""
    find_package(urls.sparkSession)

    def one(url: str) -> tuple[str | None, str | None]:
        said = None
        for _ in range(tries):
            try:
                return fetch(url, 0), None
            except Exception as e:
                said = f"{type(e).__name__}: {e}"[:500]
            time.sleep(pause)
        return None, said

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [one(u) for u in p["url"]]
            yield pd.DataFrame({"url": p["url"], "html": [g[0] for g in got], "error": [g[1] for g in got]})

    return urls.where("url is not null").select("url").distinct().mapInPandas(run, "url string, html string, error string")


def listing(spark: SparkSession, url: str, fetch: Fetch = fetch_url, most: int = 1000) -> DataFrame:
    """Products (id, name, url) of a listing whose button for more is pressed until it is gone, or the page stays the same."""
    page = fetch(url, 0)
    for pressed in range(1, most):
        if not html.more_products(html.tree(page)):
            break
        longer = fetch(url, pressed)
        if longer == page:
            break
        page = longer
    return html.catalog(spark.createDataFrame([(page,)], "html string"), url).dropDuplicates(["url"])


def crawled(products: DataFrame, fetch: Fetch = fetch_url) -> tuple[DataFrame, DataFrame]:
    """Products (ord, id, name, url) with what their pages say, and the FAQs of those pages."""
    got = pages(products.select("url"), fetch).where(F.col("html").isNotNull()).select("url", "html")
    full = html.enriched(products, got)
    return html.described(full), html.faqs(full, got)
