"""Documents of outside systems as a feed of changes: a data source to pull in pages or to stream, with cursors and tombstones.

A feed is a folder. Each publication is a subfolder ``seq=n`` of Parquet files, seen once
Spark has marked it complete, and never changed. A page is one file. A cursor names the
last page that was taken; empty means from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "document_feed"
FEED = "external_id string, revision string, title string, document_type string, content string, deleted boolean, cursor string"
_WRITTEN = ["external_id", "revision", "title", "document_type", "content", "deleted"]
DONE = "_SUCCESS"
#: Bytes of a row group of a page; bytes that a reader takes of a column, and rows that it gives, at a time.
GROUP_BYTES, READ_BYTES, BATCH_ROWS = 4 << 20, 1 << 20, 250


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root or root.startswith("file:"):
        scheme, _, rest = root.partition(":")
        return pafs.FileSystem.from_uri("file://" + "/" + rest.lstrip("/") if scheme == "file" else root)
    return pafs.LocalFileSystem(), root


def pages(root: str, after: str = "") -> list[str]:
    """The cursors of all complete pages behind one, in order; only publications from that one's on are listed."""
    fs, base = _opened(root)
    if after and (len(after.split("/")) != 2 or not after.startswith("seq=")):
        raise ValueError(f"not a cursor of a feed: {after!r}")
    first = after.split("/")[0]
    out = []
    for folder in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if folder.base_name.startswith("seq=") and folder.base_name >= first:
            names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(folder.path))]
            if DONE in names:
                out += [f"{folder.base_name}/{n}" for n in names if n.endswith(".parquet")]
    return sorted(p for p in out if p > after)


def has_more(root: str, after: str) -> bool:
    return bool(pages(root, after))


class Page(InputPartition):
    def __init__(self, cursor: str):
        self.cursor = cursor


def _read(root: str, page: Page) -> Iterator[pa.RecordBatch]:
    fs, base = _opened(root)
    with fs.open_input_file(f"{base}/{page.cursor}") as f:
        # Neither the whole file nor more than a row group of it is held.
        for batch in pq.ParquetFile(f, pre_buffer=False, buffer_size=READ_BYTES).iter_batches(BATCH_ROWS, columns=_WRITTEN):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _WRITTEN), pa.array([page.cursor] * batch.num_rows, pa.string())], names=[*_WRITTEN, "cursor"])


class _Pull(DataSourceReader):
    """Pages behind ``after``, at most ``pages`` of them; each is a task."""

    def __init__(self, options: dict):
        self.root, self.after = options["path"], options.get("after", "")
        self.most = int(options["pages"]) if options.get("pages") else None
        if self.most is not None and self.most < 1:
            raise ValueError("a pull takes at least one page")

    def partitions(self) -> list[Page]:
        return [Page(c) for c in pages(self.root, self.after)[: self.most]]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)


class _Follow(DataSourceStreamReader):
    """The same pages as they come; offsets are cursors, so a restarted stream goes on behind its last batch."""

    def __init__(self, options: dict):
        self.root, self.after = options["path"], options.get("after", "")
        self.seen = self.after

    def initialOffset(self) -> dict:
        return {"cursor": self.after}

    def latestOffset(self) -> dict:
        found = pages(self.root, self.seen)
        self.seen = found[-1] if found else self.seen
        return {"cursor": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(c) for c in pages(self.root, start["cursor"]) if c <= end["cursor"]]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return _read(self.root, partition)

    def commit(self, end: dict) -> None:
        """Pages stay in the feed, so nothing is given back."""


class DocumentFeed(DataSource):
    """``spark.read`` or ``readStream`` of format ``document_feed`` with options path, after and, to pull, pages."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> _Pull:
        return _Pull(dict(self.options))

    def streamReader(self, schema) -> _Follow:
        return _Follow(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFeed)


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each document; a publication has at most one a document."""
    rest = [c for c in changes.columns if c != "external_id"]
    return changes.groupBy("external_id").agg(F.max_by(F.struct(*rest), "cursor").alias("_last")).select("external_id", "_last.*")


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """current (the columns of a feed but deleted) with changes: new revisions over old ones, tombstones taken out."""
    last = latest(changes)
    kept = current.join(last.select("external_id"), "external_id", "left_anti")
    return kept.unionByName(last.where("not deleted").select(*current.columns))


def publish(documents: DataFrame, root: str, page_rows: int = 10_000) -> int:
    """Append to a feed what a whole listing of a source changes; the number of its publication, or -1 if there is nothing.

    documents: external_id, revision, title, document_type, content. What has a new revision
    goes in, what is no longer listed gets a tombstone with its last revision. Rows without
    an id are left out; of several with one id the largest revision, then content, counts. A
    failed publication is not marked complete, so no reader sees it; the next one takes
    another number. One writer at a time.
    """
    spark = documents.sparkSession
    fs, base = _opened(root)
    fs.create_dir(base, recursive=True)
    taken = [f.base_name for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("seq=")]
    done = sorted({c.split("/")[0] for c in pages(root)})
    empty = spark.createDataFrame([], ", ".join(FEED.split(", ")[:-1]))
    old = empty.select(*_WRITTEN, F.lit("").alias("cursor"))
    if done:
        # A path for each complete publication; those that failed are not among them.
        old = spark.read.schema(empty.schema).parquet(*[f"{root}/{d}" for d in done]).withColumn("cursor", F.regexp_extract(F.input_file_name(), "(seq=[0-9]+)/[^/]*$", 1))
    was = latest(old.select("external_id", "revision", "deleted", "cursor")).select("external_id", F.col("revision").alias("_was"), F.col("deleted").alias("_gone"))
    rest = ["revision", "title", "document_type", "content"]
    now = documents.where("external_id is not null").groupBy("external_id").agg(F.max_by(F.struct(*rest), F.struct("revision", "content")).alias("_d")).select("external_id", "_d.*", F.lit(True).alias("_listed"))
    both = now.join(was, "external_id", "full")
    new = F.col("_listed") & (F.col("_gone").isNull() | F.col("_gone") | ~F.col("revision").eqNullSafe(F.col("_was")))
    gone = F.col("_listed").isNull() & ~F.col("_gone")
    out = both.where(new | gone).select("external_id", F.when(F.col("_listed"), F.col("revision")).otherwise(F.col("_was")).alias("revision"), "title", "document_type", "content", F.col("_listed").isNull().alias("deleted"))
    seq = max((int(t.removeprefix("seq=")) for t in taken), default=-1) + 1
    target = f"{root}/seq={seq:012d}"
    out.write.option("maxRecordsPerFile", page_rows).option("parquet.block.size", GROUP_BYTES).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(target)
    return seq if spark.read.schema(empty.schema).parquet(target).limit(1).count() else -1


def next_cursor(changes: DataFrame, after: str) -> str:
    """The cursor behind a pull: its last page, or the one it started from if it was empty."""
    return changes.agg(F.max("cursor")).first()[0] or after


def of_markdown(found: DataFrame, org: str, repo: str, commit: str) -> DataFrame:
    """Markdown documents of a repository (path, title, document_type, body) as a listing for ``publish``; a revision is the commit and the body's hash."""
    revision = F.concat(F.lit(commit + ":"), F.sha2("body", 256))
    return found.select(F.concat_ws("\n", F.lit(org), F.lit(repo), F.col("path")).alias("external_id"), revision.alias("revision"), "title", "document_type", F.col("body").alias("content"))
