"""A change feed as a data source: pages of changed and deleted items, followed link by link from a cursor.

A page is a file of lines: a head that names the next page (``next``) or, on the last
page, the cursor from which later changes go on (``delta``), then one JSON object for
each item.  The driver reads heads only; executors read the items, a page each.  A
stream's offset is the next unread link with the number of pages before it, so Spark's
checkpoint is the stored cursor and a batch that failed is read again from the same
pages.

Defined results: an item without an id is left out; a deleted one has ``deleted`` and no
size; an item larger than the limit is left out; a page that is not there yet is the
end of the feed; a line that is no JSON object is an error that names page and line.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "changefeed"
SCHEMA = "item_id string, name string, etag string, size long, modified string, deleted boolean, page long, pos int"
FIRST, MOST_BYTES = "page=0", 1 << 40


class Pages:
    """The pages of a feed below a folder that pyarrow can open."""

    def __init__(self, folder: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)

    def _lines(self, link: str) -> Iterator[str] | None:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{link}", allow_not_found=True))
        files = sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", ".")))
        if not files:
            return None
        return (line for path in files for line in io.TextIOWrapper(self.fs.open_input_stream(path), encoding="utf-8"))

    def after(self, link: str) -> str | None:
        """The link behind a page; None where the page is not there yet."""
        if (lines := self._lines(link)) is None:
            return None
        head = json.loads(next(lines))
        return head.get("next") or head["delta"]

    def items(self, link: str) -> Iterator[tuple[int, dict]]:
        lines = self._lines(link) or iter(())
        next(lines, None)
        for pos, line in enumerate(lines):
            try:
                item = json.loads(line)
                item.get("id")
            except (ValueError, AttributeError) as e:
                raise ValueError(f"{link}, line {pos + 2}: not a JSON object") from e
            yield pos, item

    def walk(self, link: str) -> Iterator[tuple[str, str]]:
        """(link, link behind it) of all pages that are there, from a link on."""
        while (after := self.after(link)) is not None and after != link:
            yield link, after
            link = after


class Page(InputPartition):
    def __init__(self, link: str, number: int):
        self.link, self.number = link, number


class _Reading:
    """What the two readers share: the items of a page as rows."""

    def __init__(self, options):
        self.folder, self.first = options["folder"], options.get("cursor", FIRST)
        self.most = int(options.get("mostbytes", MOST_BYTES))

    def read(self, partition: Page) -> Iterator[tuple]:
        for pos, item in Pages(self.folder).items(partition.link):
            name = str(item.get("id") or "").strip()
            gone, size = item.get("deleted") is not None, item.get("size")
            if name and (gone or (size or 0) <= self.most):
                yield name, item.get("name"), item.get("etag"), None if gone else size, item.get("modified"), gone, partition.number, pos


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(link, n) for n, (link, _) in enumerate(Pages(self.folder).walk(self.first))] or [Page(self.first, 0)]


class StreamReader(_Reading, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.known = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"link": self.first, "pages": 0}

    def latestOffset(self) -> dict:
        for _, after in Pages(self.folder).walk(self.known["link"]):
            self.known = {"link": after, "pages": self.known["pages"] + 1}
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Page]:
        walk = Pages(self.folder).walk(start["link"])
        return [Page(link, n) for n, (link, _) in zip(range(start["pages"], end["pages"]), walk, strict=False)]

    def commit(self, end: dict) -> None:
        """Offsets are kept by Spark's checkpoint; the feed itself has nothing to let go."""


class ChangeFeed(DataSource):
    """Options: ``folder``; ``cursor``, the link to begin with; ``mostBytes``, the largest item taken."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options)


def changes(spark: SparkSession, folder: str, stream: bool = False, **options: str) -> DataFrame:
    """The feed's items, from its first page or from the option ``cursor``."""
    spark.dataSource.register(ChangeFeed)
    return (spark.readStream if stream else spark.read).format(FORMAT).option("folder", folder).options(**options).load()


def cursor(folder: str, first: str = FIRST) -> str:
    """The link behind the last page that is there."""
    link = first
    for _, link in Pages(folder).walk(first):  # noqa: B007
        pass
    return link


def latest(feed: DataFrame) -> DataFrame:
    """One row per item: its last change in the order of the feed."""
    rest = [c for c in feed.columns if c not in ("item_id", "page", "pos")]
    return feed.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.struct("page", "pos")).alias("r")).select("item_id", "r.*")


def write_pages(items: DataFrame, folder: str, number: str = "page", order: str = "pos") -> None:
    """Writes items (id, name, etag, size, modified, deleted and the columns of page and order) as the pages of a feed, a file each; the last page's cursor is the number after it."""
    fields = F.struct("id", "name", "etag", "size", "modified", F.when(F.col("deleted"), F.create_map(F.lit("state"), F.lit("deleted"))).alias("deleted"))
    link = lambda c: F.concat(F.lit("page="), c.cast("string"))
    pages = items.select(F.col(number).alias("page")).distinct()
    behind = F.lead("page").over(Window.orderBy("page"))  # as many rows as pages
    head = F.when(behind.isNotNull(), F.to_json(F.struct(link(behind).alias("next")))).otherwise(F.to_json(F.struct(link(F.col("page") + 1).alias("delta"))))
    lines = items.select(F.col(number).alias("page"), F.col(order).cast("long").alias("at"), F.to_json(fields).alias("line")).union(pages.select("page", F.lit(-1).cast("long"), head))
    lines.repartition("page").sortWithinPartitions("page", "at").select("page", "line").write.partitionBy("page").text(folder)
