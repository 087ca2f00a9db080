"""Measured runs: rows and times of steps, progress, failures, and the envelope."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.plans import measured


def test_steps_are_counted_once_and_in_order(spark):
    told = []

    def progress(*step):
        told.append(step)
        raise RuntimeError("a watcher that fails")

    run = measured.Run(spark, progress)
    first = run.step("first", lambda: spark.range(7))
    assert run.step("second", lambda: first.where("id > 100")).count() == 0
    assert [(n, r) for n, r, _, _ in run.steps] == [("first", 7), ("second", 0)]
    assert [(t[0], t[1], t[2]) for t in told] == [(1, "first", 7), (2, "second", 0)]
    assert [(r["step"], r["n_rows"]) for r in run.report().orderBy("place").collect()] == [("first", 7), ("second", 0)]
    assert all(s > 0 for _, _, s, _ in run.steps)


def test_a_step_that_fails_is_in_the_report(spark):
    run = measured.Run(spark)
    with pytest.raises(Exception):
        run.step("bad", lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert run.steps[0][:2] == ("bad", -1) and run.steps[0][3]
    assert run.rows("bad") == 0


@pytest.mark.parametrize("failed", [0.0, -1.0])
def test_envelope(spark, failed):
    run = measured.Run(spark)
    asked = spark.createDataFrame([(1, "red", 2), (2, "none", 2), (3, None, 2)], "query_id long, question string, cnt int")

    def search(queries):
        return queries.where("query = 'red'").select("query_id", F.lit(1).alias("rank"), F.lit("red fox").alias("passage"))

    rows = {r["query_id"]: r for r in measured.answered(run, asked, search, model=lambda p: F.when(p.contains("none"), "").when(p.isNotNull(), "yes"), failed=failed).collect()}
    assert (rows[1]["answer"], rows[1]["ok"]) == ("yes", True)
    assert rows[1]["search_time"] == run.seconds("search") > 0 and rows[1]["generation_time"] == run.seconds("answer") > 0
    for i in (2, 3):
        assert rows[i]["answer"] == "No answer was found." and not rows[i]["ok"]
        assert rows[i]["search_time"] == rows[i]["generation_time"] == failed
    assert (run.rows("search"), run.rows("answer")) == (1, 3)
