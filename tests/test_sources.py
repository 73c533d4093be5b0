"""Formats, stores, data source and streams."""

import urllib.error

import pytest

from docketry.plans import source_queries as Q
from docketry.sources import directory, listings, packages, store
from docketry.streaming import incremental


def test_docx_blocks():
    blocks = packages.parse_docx(Q._docx("Head 1", "x"))
    assert [b["type"] for b in blocks] == ["heading", "paragraph", "heading", "table", "heading"]
    assert blocks[3]["heading_path"] == ["Head 1", "Sub"] and blocks[3]["rows"] == [["a", "b"]]


def test_sheet_stops_after_an_empty_tail():
    rows = [["x"], *[[""]] * 100, ["late"]]
    assert packages.sheets(Q._xlsx(rows))["List"] == [["x"]]
    assert len(packages.sheets(Q._xlsx([["x"], *[[""]] * 99, ["late"]]))["List"]) == 101


def test_text_is_split_at_blank_lines():
    assert [b["text"] for b in packages.parse_text(b"\xef\xbb\xbfa\r\nb\r\n\r\n\r\n c \n")] == ["a\nb", "c"]


def test_records_are_checked(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "cast(id AS string) s")
    entry = store.write_records(df, str(tmp_path), "r", ["id"])
    assert store.write_records(df.repartition(3), str(tmp_path), "r", ["id"]) == entry
    assert store.read_records(spark, entry, df.schema).count() == 10
    with pytest.raises(ValueError, match="integrity"):
        store.read_records(spark, entry | {"digest": "0"}, df.schema)


def test_retry_and_no_retry():
    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError
        return "ok"

    waits = []
    assert directory.get_with_retry("u", flaky, sleep=waits.append) == "ok" and waits == [0.5, 1.0]

    def gone(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "", None, None)

    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        directory.get_with_retry("u", gone, sleep=waits.append)
    assert len(calls) == 1


def page(url):
    return f'<a href="/m/TSGR1_124b/">TSGR1_124b</a><a href="TSGR1_125">x</a><a href="?C=N">s</a><a href="#x">y</a><a href="TSGR1_125">again</a><p>{url}</p>'


def test_directory_source_and_listing(spark):
    spark.dataSource.register(directory.DirectorySource)
    pages = spark.read.format("meeting_directory").option("url", "http://h/m/").option("fetch", "tests.test_sources:page").load()
    links = listings.page_links(pages)
    assert [(r.meeting, r.link) for r in listings.meetings(links, "TSGR1_").collect()] == [("124bis", "http://h/m/TSGR1_124b/"), ("125", "http://h/m/TSGR1_125")]
    found = listings.meetings(links, "TSGR1_")
    assert listings.resolve_meeting(found, "124b").first().meeting == "124bis" and listings.resolve_meeting(found, "99").count() == 0


def test_stream_does_work_once(spark, tmp_path):
    src, out, done = (str(tmp_path / x) for x in ("in", "out", "done"))
    schema = "k long, v string"

    def run():
        s = spark.readStream.schema(schema).parquet(src)
        incremental.run_stream(s, done, ["k"], ["v"], lambda b: b.write.mode("append").parquet(out), str(tmp_path / "cp")).awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(src)
    run()
    spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], schema).write.mode("append").parquet(src)
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (2, "c"), (3, "d")]


def test_partition_overwrite(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string").write.partitionBy("k").parquet(p)
    store.overwrite_keys(spark.createDataFrame([(9, "b")], "x int, k string"), p, ["k"])
    assert sorted((r.x, r.k) for r in spark.read.parquet(p).collect()) == [(1, "a"), (9, "b")]
