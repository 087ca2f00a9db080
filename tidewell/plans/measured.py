"""Runs of chains step by step, with rows and wall-clock time of every step and no jobs of their own for it.

A step's rows are written once into the shared folder, which is the step's only run: its rows are counted by an
observation of that very job, and what follows reads the written table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.term_index import scratch
from .answer import Model, answers
from .chains import SORRY, SearchFunction, fingerprint, with_envelope

REPORT = "step string, place int, n_rows long, seconds double, problem string"


@dataclass
class Run:
    """The steps of one run: (step, rows, seconds, problem) in order.

    progress: told (steps done, step, rows, seconds) after each; an error of its own changes nothing.
    """

    spark: SparkSession
    progress: Callable[[int, str, int, float], None] | None = None
    steps: list[tuple[str, int, float, str | None]] = field(default_factory=list)

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``make`` plans, written and counted. A step that fails is in the report with its
        problem and -1 rows, and its error goes on."""
        seen, began = Observation(), time.perf_counter()
        try:
            table = scratch(make().observe(seen, F.count(F.lit(1)).alias("n")))
        except Exception as error:
            self.steps.append((name, -1, time.perf_counter() - began, type(error).__name__))
            raise
        self.steps.append((name, int(seen.get["n"]), time.perf_counter() - began, None))
        if self.progress is not None:
            try:
                self.progress(len(self.steps), *self.steps[-1][:3])
            except Exception:  # noqa: BLE001  who watches a run must not end it
                pass
        return table

    def seconds(self, name: str) -> float:
        return sum(s for n, _, s, _ in self.steps if n == name)

    def rows(self, name: str) -> int:
        return sum(max(r, 0) for n, r, _, _ in self.steps if n == name)

    def report(self) -> DataFrame:
        """REPORT rows of the steps so far."""
        return self.spark.createDataFrame([(n, i, r, s, p) for i, (n, r, s, p) in enumerate(self.steps)], REPORT)


def enveloped(rows: DataFrame, run: Run, search: str = "search", generation: str = "answer", failed: float = 0.0, sorry: str = SORRY) -> DataFrame:
    """Answers in an envelope with search_time and generation_time, the seconds of their batch's steps. A row
    that is not ok has the apology, no documents and ``failed`` for both times: 0, or -1 in a dialogue."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    timed = {c: F.when(ok, F.lit(run.seconds(step))).otherwise(F.lit(float(failed))) for c, step in (("search_time", search), ("generation_time", generation))}
    return with_envelope(rows.withColumns(timed), sorry=sorry)


def answered(run: Run, asked: DataFrame, search: SearchFunction, budget: int = 512, model: Model = fingerprint, failed: float = 0.0) -> DataFrame:
    """query_id, question, context, answer, ok, search_time, generation_time of asked (query_id, question,
    cnt): the single-turn chain as the two steps ``search`` and ``answer`` of a run."""
    hits = run.step("search", lambda: search(asked.select("query_id", F.col("question").alias("query"), "cnt")).withColumnRenamed("passage", "text"))
    rows = run.step("answer", lambda: answers(asked.select("query_id", "question"), hits, budget, model))
    return enveloped(rows, run, failed=failed)
