"""What is small costs few jobs and tasks on the driver, whatever the number of shuffle partitions."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, mixing
from tidewell.llm.components import components

PARTS = 60


@pytest.fixture
def dealt(spark):
    """Every shuffle has PARTS partitions."""
    held = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@contextmanager
def counted(spark, out: dict):
    """``out`` gets the number of jobs and tasks that ran inside."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        yield
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = {s for j in jobs for s in j.stageIds}
    out |= {"jobs": len(jobs), "tasks": sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))}


def test_marks_are_fetched_by_few_jobs(spark, dealt):
    hashes = spark.range(4000).select(F.xxhash64(F.col("id") % 3900).alias("h"))
    ran = {}
    with counted(spark, ran):
        table = exact_dedup.repeated_bits(hashes, 1 << 22)
    twice = np.array([r["h"] for r in hashes.groupBy("h").count().where("count > 1").collect()], dtype=np.int64).view(np.uint64)
    places = np.concatenate(exact_dedup._places(twice, 1 << 22))
    assert len(twice) == 100 and (table[places >> np.uint64(3)] >> (np.uint8(7) - (places & np.uint64(7)).astype(np.uint8)) & 1).all()
    assert ran["jobs"] <= spark.sparkContext.defaultParallelism + 3


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_components_of_few_nodes(spark, dealt, most):
    """Labels of many rounds: a chain, a star and a pair; with shuffles too the same."""
    rows = [(i + 1, i) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(5000, 4000)]
    links, ran = spark.createDataFrame(rows, "a long, b long"), {}
    with counted(spark, ran):
        got = {r["node"]: r["comp"] for r in components(links, most=most).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([7, *range(1000, 1100)], 7), 5000: 4000, 4000: 4000}
    if most:
        # two tables to begin with, then a round has no more than its shuffle's map tasks and one task a core
        assert ran["tasks"] < 8 * PARTS


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_raking_few_cells(spark, dealt):
    """One task rakes them, and by shuffles the same comes out."""
    cells = spark.createDataFrame([(f"s{i % 7}", f"l{i % 5}", f"t{i % 3}", 1 + i * i % 97) for i in range(105)], "s string, l string, t string, tokens long")
    ran = {}
    with counted(spark, ran):
        few = mixing.rake(cells, ["s", "l", "t"], 0.7, None, 2)
    assert ran["tasks"] < PARTS
    many = mixing.rake(cells, ["s", "l", "t"], 0.7, None, 2, most=0)
    key = lambda df: {(r["s"], r["l"], r["t"]): r["raked"] for r in df.collect()}
    assert key(few) == pytest.approx(key(many))
