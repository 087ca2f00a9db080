"""Streams with state: restarts, replays, messages out of order, and memories to start from."""

from __future__ import annotations

from tidewell.streaming import memory

KIND = "session_id string, seq long, role string, content string"


def stream(spark, path):
    return spark.readStream.schema(KIND).json(str(path))


def add(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").json(str(path))


def run(spark, tmp_path, rows, schema):
    sink = memory.EpochSink(spark, str(tmp_path / "out"), schema)
    sink.start(rows, str(tmp_path / "checkpoint")).awaitTermination()
    return sink


def test_memory_goes_on_after_a_restart(spark, tmp_path):
    spec, told = memory.MemorySpec(max_tokens=20, threshold=0.5), lambda prompt: f"<{len(prompt.splitlines()) - 1}>"
    add(spark, tmp_path / "in", [("a", i, "user" if i % 2 else "assistant", f"m{i}" + "x" * 18) for i in range(1, 4)] + [("b", 1, "user", "hello")])
    first = run(spark, tmp_path, memory.session_memory(stream(spark, tmp_path / "in"), spec, told), memory.MEMORY).read().collect()
    assert {(r["session_id"], r["seq"]): (r["kept"], r["running"]) for r in first} == {("a", 1): (1, ""), ("a", 2): (2, ""), ("a", 3): (1, "<2>"), ("b", 1): (1, "")}
    # the same messages again, one that is late, and new ones: only the new ones count
    add(spark, tmp_path / "in", [("a", 3, "user", "again"), ("a", 0, "user", "late"), ("a", 4, "assistant", "y" * 40), ("a", 5, "user", "z"), ("b", 2, "assistant", None)])
    rows = run(spark, tmp_path, memory.session_memory(stream(spark, tmp_path / "in"), spec, told), memory.MEMORY).read()
    assert rows.count() == 7 and rows.select("epoch").distinct().count() == 2
    last = rows.where("session_id = 'a' and seq = 5").first()
    assert (last["kept"], last["folds"], last["running"], last["history"]) == (1, 2, "<2>\n<2>", "<2>\n<2>\nz")


def test_memory_starts_from_what_is_known(spark, tmp_path):
    add(spark, tmp_path / "in", [("a", 7, "user", "new"), ("a", 3, "user", "old")])
    known = spark.createDataFrame([("a", "before", 5)], "session_id string, running string, last long")
    rows = memory.session_memory(stream(spark, tmp_path / "in"), known=known)
    got = run(spark, tmp_path, rows, memory.MEMORY).read().collect()
    assert [(r["seq"], r["history"]) for r in got] == [(7, "before\nnew")]


def test_events_are_numbered_on_and_replays_add_nothing(spark, tmp_path):
    add(spark, tmp_path / "in", [("a", 1, "user", "q"), ("a", 2, "assistant", "é\"")])
    run(spark, tmp_path, memory.session_events(stream(spark, tmp_path / "in")), memory.EVENTS)
    add(spark, tmp_path / "in", [("a", 3, "system", "s"), ("a", 2, "assistant", "twice")])
    sink = run(spark, tmp_path, memory.session_events(stream(spark, tmp_path / "in")), memory.EVENTS)
    rows = sink.read().orderBy("event_no").collect()
    assert [(r["event_no"], r["seq"]) for r in rows] == [(0, 1), (1, 2), (2, 2), (3, 3)]
    assert rows[1]["event"] == 'data: {"type":"answer","data":"é\\""}\n\n'
    # the last batch comes again, as after a failure between the write and the commit
    last = max(r["epoch"] for r in rows)
    sink.write(spark.createDataFrame([tuple(r)[:4] for r in rows if r["epoch"] == last], memory.EVENTS), last)
    assert sink.read().count() == 4
