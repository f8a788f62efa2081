"""The document feed: cursors, pages, tombstones, failed publications, and a stream that is stopped and started again."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import connector, repository

LISTING = "external_id string, revision string, title string, document_type string, content string"


def listing(spark, rows):
    return spark.createDataFrame([(i, r, f"T{i}", "guide", c) for i, r, c in rows], LISTING)


def pull(spark, root, after="", **options):
    return spark.read.format(connector.FORMAT).option("path", root).option("after", after).options(**options).load()


def test_pulls_go_on_behind_their_cursor(spark, tmp_path):
    connector.register(spark)
    root = str(tmp_path / "feed")
    assert not connector.has_more(root, "") and connector.pages(root) == []
    rows = [(f"d{i}", "r1", f"text {i}") for i in range(25)]
    assert connector.publish(listing(spark, [*rows, (None, "r1", "no id"), ("d1", "r0", "older")]), root, 4) == 0
    seen, at, n = [], "", 0
    while connector.has_more(root, at):
        page = pull(spark, root, at, pages=2)
        seen += page.collect()
        at, n = connector.next_cursor(page, at), n + 1
    assert n > 2 and sorted(r.external_id for r in seen) == sorted(i for i, _, _ in rows) and not any(r.deleted for r in seen)
    assert {r.external_id: r.content for r in seen}["d1"] == "text 1"
    assert connector.publish(listing(spark, rows), root) == -1 and pull(spark, root, at).count() == 0
    assert connector.publish(listing(spark, [("d0", "r2", "new"), *rows[2:], ("d99", "r1", "more")]), root) == 2
    got = {r.external_id: (r.revision, r.deleted, r.content) for r in pull(spark, root, at).collect()}
    assert got == {"d0": ("r2", False, "new"), "d1": ("r1", True, None), "d99": ("r1", False, "more")}
    # What was taken out comes back as new.
    assert connector.publish(listing(spark, [("d0", "r2", "new"), *rows[1:], ("d99", "r1", "more")]), root) == 3
    whole = pull(spark, root)
    state = connector.apply_changes(whole.where("false").drop("deleted"), whole)
    assert {r.external_id: r.content for r in state.collect()} == {i: c for i, _, c in rows} | {"d0": "new", "d99": "more"}
    assert pull(spark, root, pages=1).select("cursor").distinct().count() == 1
    for bad in ("7", "seq=1", "x/y"):
        with pytest.raises(ValueError):
            connector.pages(root, bad)


def test_failed_publications_are_not_seen(spark, tmp_path):
    connector.register(spark)
    root = str(tmp_path / "feed")
    connector.publish(listing(spark, [("a", "r1", "x")]), root)
    listing(spark, [("b", "r1", "y")]).withColumn("deleted", F.lit(False)).write.parquet(f"{root}/seq=000000000001")
    (tmp_path / "feed" / "seq=000000000001" / "_SUCCESS").unlink()
    assert [r.external_id for r in pull(spark, root).collect()] == ["a"]
    assert connector.publish(listing(spark, [("a", "r1", "x"), ("b", "r1", "y")]), root) == 2
    assert sorted(r.external_id for r in pull(spark, root).collect()) == ["a", "b"]


def test_streams_resume_without_repeats_or_losses(spark, tmp_path):
    connector.register(spark)
    root, out = str(tmp_path / "feed"), str(tmp_path / "out")
    (tmp_path / "tree" / "docs").mkdir(parents=True)
    for k in range(3):
        (tmp_path / "tree" / "docs" / f"page-{k}.md").write_text(f"# Page {k}\nbody")
        if k == 2:
            (tmp_path / "tree" / "docs" / "page-0.md").unlink()
        found = repository.markdown_documents(repository.walk(spark, str(tmp_path / "tree")))
        connector.publish(connector.of_markdown(found, "o", "r", "sha"), root)
        stream = spark.readStream.format(connector.FORMAT).option("path", root).load()
        run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="0 seconds").start(out)
        run.processAllAvailable()
        run.stop()
    rows = {(r.cursor.split("/")[0][-1], r.title, r.external_id.split("\n")[-1], r.deleted) for r in spark.read.parquet(out).collect()}
    assert rows == {("0", "Page 0", "docs/page-0.md", False), ("1", "Page 1", "docs/page-1.md", False), ("2", "Page 2", "docs/page-2.md", False), ("2", None, "docs/page-0.md", True)}
    assert spark.read.parquet(out).count() == 4


def test_pages_are_read_by_row_groups(spark, tmp_path):
    """A page is one file, of which a reader holds no more than a row group."""
    connector.register(spark)
    root = str(tmp_path / "feed")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.sha2(F.concat("id", F.lit("-"), k.cast("string")), 256)), " ")
    rows = spark.range(3000).select(F.col("id").cast("string").alias("external_id"), F.lit("r1").alias("revision"), F.lit("T").alias("title"), F.lit("guide").alias("document_type"), F.lit("").alias("content"), F.col("id"))
    rows = rows.withColumn("content", text).drop("id").coalesce(1)
    connector.publish(rows, root)
    found = connector.pages(root)
    files = [pq.ParquetFile(f"{root}/{p}").metadata for p in found]
    assert max(f.num_row_groups for f in files) > 1
    assert max(f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)) < 2 * connector.GROUP_BYTES
    got = pull(spark, root).select("external_id", "content")
    assert got.exceptAll(rows.select("external_id", "content")).count() == 0 and got.count() == 3000
