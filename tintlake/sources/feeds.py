"""Python data sources of the feeds that come in pages and windows, and the target that results are sent to.

Each page or window is a partition of its own. What must be whole is checked where it is read, so a part that is missing
fails the job instead of passing for less data. Files are reached through ``pyarrow.fs``, so folders are addresses of
stores that it knows, or local paths.
"""

from __future__ import annotations

import importlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import absolute_url

PAGES = "page int, place int, next string, tvdb_id long, title string, score double, image string"
CHANGES = "media_type string, tmdb_id long, start string, end string"
#: What was accepted, by a job's commit: the writer's name for the job, and the batch.
ACKNOWLEDGED = "job string, batch long"
#: Takes the JSON of a batch; an exception means that it wasn't accepted.
Send = Callable[[str, str], None]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder) if ":/" in folder else f"file://{folder}")


def _files(folder: str) -> dict[str, int]:
    """Paths below a folder, without it, and their sizes; hidden files don't count."""
    files, path = _open(folder)
    found = files.get_file_info(fs.FileSelector(path, recursive=True))
    names = {f.path[len(path) :].lstrip("/"): f.size for f in found if f.type == fs.FileType.File}
    return {n: size for n, size in names.items() if not re.search(r"(^|/)[._]", n)}


def _documents(folder: str, names: list[str]) -> Iterator[dict]:
    """The JSON documents of files: one each, or one a line."""
    files, path = _open(folder)
    for name in names:
        with files.open_input_stream(f"{path}/{name}") as f:
            content = f.read().decode()
        try:
            yield json.loads(content)
        except json.JSONDecodeError:
            yield from map(json.loads, filter(str.strip, content.splitlines()))


# ---------------------------------------------------------------- pages of a listing


@dataclass
class Page(InputPartition):
    number: int
    names: list[str]
    last: bool


class ListingReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Page]:
        found: dict[int, list[str]] = {}
        for name in _files(self.folder):
            n = re.search(r"(?:^|/)page=(\d+)/[^/]*$|(?:^|[^0-9])(\d+)\.json$", name)
            if n:
                found.setdefault(int(n[1] or n[2]), []).append(name)
        if not found:
            raise ValueError(f"there is no page of a listing in {self.folder}")
        missing = [n for n in range(max(found)) if n not in found][:5]
        if missing:
            raise ValueError(f"the listing {self.folder} has pages up to {max(found)}, but not {missing}")
        return [Page(n, sorted(names), n == max(found)) for n, names in sorted(found.items())]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        documents = list(_documents(self.folder, page.names))
        if len(documents) != 1:
            raise ValueError(f"page {page.number} of {self.folder} is {len(documents)} documents")
        rows = [r or {} for r in documents[0].get("data") or []]
        following = (documents[0].get("links") or {}).get("next") or None
        goes_on = bool(rows and following)
        if goes_on and page.last:
            raise ValueError(f"the listing {self.folder} goes on beyond its pages: {page.number} is followed by {following}")
        if not goes_on and not page.last:
            raise ValueError(f"page {page.number} ends the listing {self.folder}, but there are more")
        named = re.search(r"page=(\d+)", following or "") or re.fullmatch(r"(\d+)", following or "")
        if goes_on and named and int(named[1]) != page.number + 1:
            raise ValueError(f"page {page.number} of {self.folder} is followed by {following}")
        number = lambda x: None if x is None else float(x)
        columns = {
            "page": pa.array([page.number] * len(rows), pa.int32()), "place": pa.array(range(len(rows)), pa.int32()), "next": pa.array([following] * len(rows), pa.string()),
            "tvdb_id": pa.array([int(r["id"]) if r.get("id") else None for r in rows], pa.int64()), "title": pa.array([r.get("name") for r in rows], pa.string()),
            "score": pa.array([number(r.get("score")) for r in rows], pa.float64()), "image": pa.array([r.get("image") for r in rows], pa.string()),
        }
        yield pa.RecordBatch.from_pydict(columns)


class ListingPages(DataSource):
    """``listing_pages``: the numbered pages of a listing in a folder (N.json, or below page=N), from 0, a partition each.

    Pages must form a chain: none is left out, each but the last names a next one and has rows, the last doesn't. A page
    that breaks it fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"])


def read_pages(spark: SparkSession, folder: str, kind: str, base: str) -> DataFrame:
    """(kind, tvdb_id, title, score, image, ordinal) of a listing's pages, in ``ordinal`` as they were listed; rows
    without an id are left out."""
    spark.dataSource.register(ListingPages)
    x = spark.read.format("listing_pages").load(folder).where("tvdb_id IS NOT NULL AND tvdb_id <> 0")
    ordinal = F.shiftleft(F.col("page").cast("long"), 32) + F.col("place")
    return x.select(F.lit(kind).alias("kind"), "tvdb_id", "title", "score", absolute_url(F.col("image"), base).alias("image"), ordinal.alias("ordinal"))


# ---------------------------------------------------------------- windows of changes


@dataclass
class Window(InputPartition):
    media_type: str
    start: str
    end: str
    names: list[str]


class _Changes:
    """An offset is a day per kind: changes up to it are read. It moves along windows that meet, so a window that
    hasn't come yet holds back those after it."""

    def __init__(self, folder: str, since: str, kinds: list[str]):
        self.folder, self.since, self.kinds = folder, since, kinds

    def _windows(self) -> dict[tuple[str, str, str], list[str]]:
        day, out = r"(\d{4}-\d\d-\d\d)", {}
        for name in _files(self.folder):
            m = re.search(rf"media_type=(\w+)/start={day}/end={day}/", name) or re.search(rf"changes_([a-z]+)_{day}_{day}[^/]*\.json$", name)
            if m and m[1] in self.kinds:
                out.setdefault((m[1], m[2], m[3]), []).append(name)
        return out

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.kinds, self.since)

    def latestOffset(self) -> dict:
        out = self.initialOffset()
        for kind, start, end in sorted(self._windows()):
            if start <= out[kind] < end:
                out[kind] = end
        return out

    def partitions(self, start: dict | None = None, end: dict | None = None) -> list[Window]:
        start, end = start or self.initialOffset(), end or self.latestOffset()
        return [Window(k, a, b, sorted(names)) for (k, a, b), names in sorted(self._windows().items()) if b > start[k] and b <= end[k]]

    def read(self, window: Window) -> Iterator[pa.RecordBatch]:
        documents = list(_documents(self.folder, window.names))
        pages, total = {d.get("page") or 1 for d in documents}, max((d.get("total_pages") or 1 for d in documents), default=0)
        if pages != set(range(1, total + 1)):
            raise ValueError(f"changes of {window.media_type} from {window.start} to {window.end} have {total} pages, here are {sorted(pages)}")
        ids = sorted({r["id"] for d in documents for r in d.get("results") or [] if r and r.get("id")})
        repeated = lambda x: pa.array([x] * len(ids), pa.string())
        yield pa.RecordBatch.from_pydict({"media_type": repeated(window.media_type), "tmdb_id": pa.array(ids, pa.int64()), "start": repeated(window.start), "end": repeated(window.end)})


class ChangeReader(_Changes, DataSourceReader):
    """All windows since the first day."""


class ChangeStreamReader(_Changes, DataSourceStreamReader):
    """Windows between two offsets."""


class ChangeFeed(DataSource):
    """``change_feed``: ids of titles that changed, from windows of pages in a folder (changes_KIND_START_END*.json, or
    below media_type=KIND/start=START/end=END), each window a partition. As a stream it goes on from the last day of
    each kind that its checkpoint has. Options: ``since``, the first day; ``kinds``, with commas. A window whose pages
    aren't all there fails the read."""

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return CHANGES

    def _what(self) -> tuple[str, str, list[str]]:
        return self.options["path"], self.options.get("since", "0001-01-01"), self.options.get("kinds", "movie,tv").split(",")

    def reader(self, schema) -> ChangeReader:
        return ChangeReader(*self._what())

    def streamReader(self, schema) -> ChangeStreamReader:
        return ChangeStreamReader(*self._what())


def change_stream(spark: SparkSession, folder: str, since: str) -> DataFrame:
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("change_feed").option("since", since).load(folder)


# ---------------------------------------------------------------- the target of an export


def folder_target(options: dict[str, str]) -> Send:
    """A target that is a folder (option ``folder``): each batch is a file of its name, so one sent twice is there once."""
    files, path = _open(options["folder"])
    files.create_dir(path, recursive=True)

    def send(name: str, items: str) -> None:
        with files.open_output_stream(f"{path}/{name}.json") as f:
            f.write(items.encode())

    return send


@dataclass
class Accepted(WriterCommitMessage):
    batches: list[int]
    refused: str | None


class _Sender:
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.job = self.options.get("job") or uuid.uuid4().hex

    def write(self, rows: Iterator) -> Accepted:
        """A task sends its batches until one is refused; those after it aren't tried."""
        module, _, factory = self.options["sender"].partition(":")
        send, accepted = getattr(importlib.import_module(module), factory)(self.options), []
        for r in rows:
            try:
                send(f"{self.job}-{r.batch:06d}", r["items"])
            except Exception as e:  # noqa: BLE001  whatever the target says
                return Accepted(accepted, str(e)[:500])
            accepted.append(r.batch)
        return Accepted(accepted, None)

    def acknowledge(self, messages: list[Accepted | None], name: str) -> None:
        """Writes which batches arrived, of those tasks alone whose messages count."""
        files, path = _open(self.options["acknowledge"])
        files.create_dir(path, recursive=True)
        lines = [json.dumps({"job": self.job, "batch": b}) for m in messages if m for b in m.batches]
        with files.open_output_stream(f"{path}/{name}.json") as f:
            f.write("".join(x + "\n" for x in lines).encode())


class ExportWriter(_Sender, DataSourceWriter):
    def commit(self, messages: list[Accepted | None]) -> None:
        self.acknowledge(messages, self.job)

    def abort(self, messages: list[Accepted | None]) -> None:
        """Nothing is acknowledged: all that was sent will be sent again."""


class ExportStreamWriter(_Sender, DataSourceStreamWriter):
    """A micro-batch that runs again after a failure writes its acknowledgements again, under its own number."""

    def commit(self, messages: list[Accepted | None], batchId: int) -> None:  # noqa: N803
        self.acknowledge(messages, f"{self.job}-{batchId:09d}")

    def abort(self, messages: list[Accepted | None], batchId: int) -> None:  # noqa: N803
        """Nothing is acknowledged."""


class ExportTarget(DataSource):
    """``export_target``: rows (batch, items), each the JSON of some titles, go to a target from the tasks that hold them.

    Options: ``sender``, module:function of a factory that takes the options and gives a ``Send``; ``acknowledge``, a
    folder for ACKNOWLEDGED; ``job``, a name that batches are sent under. Batches arrive at least once: what a task sent
    before it was lost, or before the job was aborted, is sent again.
    """

    @classmethod
    def name(cls) -> str:
        return "export_target"

    def schema(self) -> str:
        return "batch long, items string"

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> ExportStreamWriter:
        return ExportStreamWriter(self.options)


def send_batches(batches: DataFrame, acknowledge: str, sender: str = f"{__name__}:folder_target", **options: str) -> DataFrame:
    """Sends (batch, items) from the tasks that hold them; the ACKNOWLEDGED batches."""
    spark = batches.sparkSession
    spark.dataSource.register(ExportTarget)
    batches.select("batch", "items").write.format("export_target").options(sender=sender, acknowledge=acknowledge, **options).mode("append").save()
    return acknowledged(spark, acknowledge)


def acknowledged(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ACKNOWLEDGED).json(folder).distinct()
