"""Python data sources: listings of a shop as batch or stream, and a JSON array written by many tasks.

spark.dataSource.register(listing_source(fetch)) makes spark.read.format("shop_listing") and
spark.readStream.format("shop_listing") read; register(JsonArray) makes df.write.format("json_array") write.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from kelpie.functions import text as T
from kelpie.sources import html
from kelpie.sources.files import ARRAY
from kelpie.sources.web import Fetch, fetch_url

LISTED = "listing string, pressed int, href string, name string"


def _urls(options) -> list[str]:
    return list(dict.fromkeys(u for u in json.loads(options.get("urls", "[]")) if u))


def _links(page: str) -> dict[str, str | None]:
    """Names by target, the first of each, in page order."""
    out: dict[str, str | None] = {}
    for x in html.catalog_links(html.tree(page)):
        out.setdefault(x["href"], x["name"])
    return out


@dataclass
class Pages(InputPartition):
    """Pages of one listing, by how often its button for more was pressed: from first, up to but without last; all if there is no last."""

    url: str
    first: int = 0
    last: int | None = None


def listing_source(fetch: Fetch = fetch_url, name: str = "shop_listing", most: int = 1000) -> type[DataSource]:
    """A source of the product links of listings, whose pages fetch(url, pressed) gives. most: presses of one button.

    Option urls: a JSON array. A partition is one listing. A page shows what its predecessor does and more; a row is a
    link that the page before lacked, so none comes twice from one listing. A stream's offset is the number of pages of
    each listing; after a restart it goes on behind the last committed one.
    """

    def read_pages(p: Pages) -> Iterator[tuple]:
        before = _links(fetch(p.url, p.first - 1)) if p.first else {}
        text = None
        for k in range(p.first, most if p.last is None else p.last):
            page = fetch(p.url, k)
            if page == text:
                return
            text, links = page, _links(page)
            yield from ((p.url, k, h, n) for h, n in links.items() if h not in before)
            before = before | links
            if p.last is None and not html.more_products(html.tree(page)):
                return

    class Batch(DataSourceReader):
        def __init__(self, options) -> None:
            self.urls = _urls(options)

        def partitions(self) -> list[Pages]:
            return [Pages(u) for u in self.urls] or [Pages("", 0, 0)]

        def read(self, partition: Pages) -> Iterator[tuple]:
            return read_pages(partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, options) -> None:
            self.urls = _urls(options)
            self.known: dict[str, int] = {}

        def initialOffset(self) -> dict:
            return dict.fromkeys(self.urls, 0)

        def latestOffset(self) -> dict:
            """As many pages as each listing has now, counted on from last time; from the first page after a restart."""
            for u in self.urls:
                n = self.known.get(u, 0)
                while n < most and (n == 0 or html.more_products(html.tree(fetch(u, n - 1)))):
                    n += 1
                self.known[u] = n
            return dict(self.known)

        def partitions(self, start: dict, end: dict) -> list[Pages]:
            return [Pages(u, start.get(u, 0), n) for u, n in end.items() if n > start.get(u, 0)]

        def read(self, partition: Pages) -> Iterator[tuple]:
            return read_pages(partition)

        def commit(self, end: dict) -> None:
            pass

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LISTED

        def reader(self, schema) -> DataSourceReader:
            return Batch(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Stream(self.options)

    return Listing


def products(listed: DataFrame) -> DataFrame:
    """Products (id, name, url) of rows LISTED."""
    from urllib.parse import urljoin

    @F.udf("string")
    def absolute(base: str, href: str) -> str:
        return urljoin(base, href)

    url = absolute("listing", "href")
    return listed.select(T.url_id(url).alias("id"), "name", url.alias("url"))


# ---- a JSON array by many tasks


@dataclass
class Part(WriterCommitMessage):
    task: int
    file: str
    rows: int


class _ArrayWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.staging = path.rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"

    def _at(self, *names: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, posixpath.join(root, *names)

    def write(self, iterator: Iterator) -> Part:
        """One file: the records of a task, one a line, all but the first behind a comma."""
        task = TaskContext.get().partitionId()
        file = f"{task:05d}-{uuid.uuid4().hex}"
        system, folder = self._at(self.staging)
        system.create_dir(folder)
        rows = 0
        with system.open_output_stream(posixpath.join(folder, file)) as out:
            for row in iterator:
                out.write((("," if rows else "") + row[0] + "\n").encode())
                rows += 1
        return Part(task, file, rows)

    def commit(self, messages: list[Part | None]) -> None:
        """The files in the order of their tasks, with brackets and commas between them: read one after the other they are one array."""
        system, root = self._at()
        system.create_dir(root)
        for x in system.get_file_info(fs.FileSelector(root)):
            if x.base_name == self.staging:
                continue
            if not self.overwrite:
                raise FileExistsError(self.path)
            (system.delete_dir if x.type == fs.FileType.Directory else system.delete_file)(x.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.task)

        def small(name: str, text: str) -> None:
            with system.open_output_stream(posixpath.join(root, name)) as out:
                out.write(text.encode())

        for k, m in enumerate(parts):
            small(f"part-{k:05d}-0.json", "," if k else "[")
            system.move(posixpath.join(root, self.staging, m.file), posixpath.join(root, f"part-{k:05d}-1.json"))
        small(f"part-{len(parts):05d}-0.json", "]\n" if parts else "[]\n")
        small(ARRAY, "")
        self._drop()

    def abort(self, messages: list[Part | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, folder = self._at(self.staging)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class JsonArray(DataSource):
    """A sink for rows of one string, a JSON record, that are written as one array in the order of the partitions."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ArrayWriter(self.options["path"], overwrite)


def write_json_array(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON array, a record a line, in order, written by as many tasks as the rows have partitions.

    The folder's part files, read in the order of their names, are the array; nothing is there unless all tasks ended well.
    """
    df.sparkSession.dataSource.register(JsonArray)
    own = F.to_json(F.struct(*(c for c in df.columns if c != "ord")), {"ignoreNullFields": "false"}).alias("value")
    (df.orderBy(*order) if order else df).select(own).write.format("json_array").mode("overwrite").save(path)
