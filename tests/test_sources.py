"""The source of event lines, as a table and as a stream, and the stored page index."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidewell.operators import maxscore
from tidewell.sources import event_log, page_index
from tidewell.streaming.memory import EpochSink


@pytest.fixture()
def log(spark, tmp_path):
    event_log.register(spark)
    folder = tmp_path / "log"
    folder.mkdir()
    return folder


def read(spark, folder, **options):
    return spark.read.format(event_log.NAME).options(**options).load(str(folder))


def test_lines_and_places(spark, log):
    first = b'data: {"type": "a", "n": 1}\n\n: note\ndata: {broken\ndata: [1]\ndata: {"n": 2}\ndata: {"type": 7}\r\ndata: {"type": "a", "x": "\xc3\xa4"}'
    (log / "one").write_bytes(first)
    (log / "two").write_bytes(b"")
    (log / "_hidden").write_bytes(b'data: {"type": "h"}\n')
    got = sorted((r["at"], r["type"], r["problem"] is None) for r in read(spark, log).collect())
    assert got == [(0, "a", True), (first.index(b'data: {"n": 2}'), None, True), (first.index(b'data: {"type": 7}'), "7", True), (first.rindex(b"data: "), "a", True)]
    kept = read(spark, log, broken="keep").where("type = 'broken'").collect()
    assert sorted(r["event"] for r in kept) == ["[1]", "{broken"] and all(r["problem"] for r in kept)


@pytest.mark.parametrize("step", [1, 3, 1 << 20])
def test_pieces_share_no_line_and_lose_none(tmp_path, monkeypatch, step):
    monkeypatch.setattr(event_log, "STEP", step)
    rows = [b"x" * (i * 7 % 23) for i in range(60)] + [b"", b"", b"end"]
    (tmp_path / "f").write_bytes(b"\n".join(rows))
    size = (tmp_path / "f").stat().st_size
    system, path = event_log.opened(str(tmp_path))
    whole = [r for r in event_log.lines(system, path, event_log.Piece("f", 0, size))]
    assert [line for _, line in whole] == rows
    for split in (1, 2, 5, 64, size):
        tasks = event_log.shared_out({"f": (0, size)}, split)
        assert [r for t in tasks for p in t.pieces for r in event_log.lines(system, path, p)] == whole


def test_small_files_share_a_task():
    tasks = event_log.shared_out({f"f{i:02}": (0, 10) for i in range(20)} | {"long": (5, 130)}, 50)
    assert len(tasks) == 7
    assert sum(p.end - p.start for t in tasks for p in t.pieces) == 325
    assert max(sum(p.end - p.start for p in t.pieces) for t in tasks) <= 50


def filled(log):
    for name in ("x1", "x2", "y1"):
        (log / name).write_text("".join(f'data: {{"type": "{t}", "n": "{name}"}}\n' for t in "abc"))


def test_options_choose_files_and_types(spark, log):
    filled(log)
    rows = event_log.read(spark, str(log), types=["a", "b"], files=["x*", "y"], splitBytes=1)
    assert sorted((r["file"], r["type"]) for r in rows.collect()) == [(f, t) for f in ("x1", "x2") for t in "ab"]
    assert rows.rdd.getNumPartitions() * 3 == read(spark, log, splitBytes=1).rdd.getNumPartitions() * 2


def test_one_table_read_twice_in_a_plan(spark, log):
    filled(log)
    rows = event_log.read(spark, str(log))
    both = rows.where("type = 'a'").join(rows.where("type = 'b' and file <> 'x2'").select("file"), "file")
    assert sorted((r["file"], r["type"]) for r in both.collect()) == [("x1", "a"), ("y1", "a")]


def test_conditions_of_sparks_reach_the_reader(spark, log):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    filled(log)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read(spark, log, splitBytes=1, pushDown="true")
        one = rows.where("file = 'x1' and type in ('a', 'b') and type = 'b'")
        assert [(r["file"], r["type"]) for r in one.collect()] == [("x1", "b")]
        assert one.rdd.getNumPartitions() * 3 == read(spark, log, splitBytes=1).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = event_log.PushedReader({"path": str(log)})
    assert list(reader.pushFilters([EqualTo(("type",), "a"), GreaterThan(("at",), 3)])) == [GreaterThan(("at",), 3)]
    assert reader.types == {"a"}


def test_a_piece_that_fails_gives_one_row(spark, log):
    for name in ("good", "gone"):
        (log / name).write_text('data: {"type": "a"}\n')
    reader = event_log.TableReader({"path": str(log), "onError": "rows"})
    parts = reader.partitions()
    os.remove(log / "gone")
    got = sorted(r for p in parts for batch in reader.read(p) for r in map(tuple, (d.values() for d in batch.to_pylist())))
    assert got == [("gone", 0, "unreadable", None, "FileNotFoundError"), ("good", 0, "a", '{"type": "a"}', None)]
    strict = event_log.TableReader({"path": str(log)})
    with pytest.raises(FileNotFoundError):
        list(strict.read(parts[0]))


def test_options_are_checked(log):
    for options in ({"broken": "maybe"}, {"onError": "no"}, {"splitBytes": "0"}):
        with pytest.raises(ValueError):
            event_log.TableReader({"path": str(log), **options})


def test_an_empty_or_missing_folder_has_no_rows(spark, log):
    assert read(spark, log).count() == 0
    assert read(spark, log / "none").count() == 0


def test_a_stream_waits_for_whole_lines_and_goes_on(spark, log, tmp_path):
    sink = EpochSink(spark, str(tmp_path / "rows"), event_log.SCHEMA)

    def run():
        sink.start(spark.readStream.format(event_log.NAME).option("splitBytes", 16).load(str(log)), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r["file"], r["at"], r["type"]) for r in sink.read().collect())

    (log / "f").write_text('data: {"type": "a"}\ndata: {"type": ')
    assert run() == [("f", 0, "a")]
    with open(log / "f", "a") as f:
        f.write('"b"}\n')
    (log / "g").write_text('data: {"type": "c"}\n')
    assert run() == [("f", 0, "a"), ("f", 20, "b"), ("g", 0, "c")]
    assert len(run()) == 3


def test_until_done(spark):
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 2, "done"), ("s", 3, "a"), ("s", 4, "done"), ("t", 9, "a"), (None, 1, "a")], "file string, at long, type string")
    assert sorted((str(r["file"]), r["at"]) for r in event_log.until_done(rows).collect()) == [("None", 1), ("s", 1), ("s", 2), ("t", 9)]


PAGES = [(1, "u1", "<p>red fox</p>"), (2, "u2", "<p>Red <b>red</b> hen</p>"), (3, None, None), (4, "u4", ""), (5, "u5", "<i>fox, red and blue</i>"), (None, "u6", "red fox blue")]


@pytest.mark.parametrize("read_all", [maxscore.READ_ALL, -1])
def test_page_index(spark, tmp_path, monkeypatch, read_all):
    monkeypatch.setattr(maxscore, "READ_ALL", read_all)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    search = page_index.searcher(page_index.build(pages, str(tmp_path / "index")))
    asked = spark.createDataFrame([(1, "red, RED fox blue!", 2), (2, "red", 5), (3, "", 3), (4, None, 3), (5, "nothing", 3), (6, "red fox", 0)], "query_id long, query string, cnt int")
    got = sorted((r["query_id"], r["rank"], r["page_id"]) for r in search(asked).collect())
    assert got == [(1, 1, 5), (1, 2, 1), (2, 1, 1), (2, 2, 2), (2, 3, 5)]
    assert {r["passage"] for r in search(asked).where("page_id = 5").collect()} == {"fox, red and blue"}


def test_page_index_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    search = page_index.searcher(page_index.build(pages, str(tmp_path / "index")))
    assert search(spark.createDataFrame([(1, "red", 3)], "query_id long, query string, cnt int")).count() == 0


def test_a_search_reads_no_html(spark, sf):
    index = page_index.for_table(spark, f"{sf}/pages.parquet")
    again = page_index.for_table(spark, f"{sf}/pages.parquet")
    assert index.pages.inputFiles() == again.pages.inputFiles()
    asked = spark.createDataFrame([(1, "the", 3)], "query_id long, query string, cnt int")
    plan = page_index.searcher(again)(asked).select(F.col("page_id"))._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "ws:array" not in plan
