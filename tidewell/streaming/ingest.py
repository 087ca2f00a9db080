"""Streams: incremental ingest into a collection, and running session state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.collection import Collection, last_shaped, with_vectors

SESSION = "session_id string, n_messages long, n_chars long, last_role string"


def ingest_stream(records: DataFrame, target: Collection, checkpoint: str, available_now: bool = True):
    """Starts a query that upserts every micro-batch; a batch that is replayed writes the same rows again."""

    def write(batch: DataFrame, _: int) -> None:
        target.upsert(with_vectors(last_shaped(batch, target.settings.mapping), target.settings.dimension), single=True)

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def session_state(messages: DataFrame) -> DataFrame:
    """Running (session_id, n_messages, n_chars, last_role) of a stream of (session_id, seq, role, content)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, chars, last, role = state.get if state.exists else (0, 0, -1, "")
        for part in parts:
            n, chars = n + len(part), chars + int(part["content"].fillna("").str.len().sum())
            top = part.loc[part["seq"].idxmax()]
            if top["seq"] >= last:
                last, role = int(top["seq"]), top["role"]
        state.update((n, chars, last, role))
        yield pd.DataFrame({"session_id": [key[0]], "n_messages": [n], "n_chars": [chars], "last_role": [role]})

    return messages.groupBy("session_id").applyInPandasWithState(update, SESSION, "n long, chars long, last long, role string", "update", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window, with a watermark; works on a stream and on a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_rows(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event): the event lines that a client gets for a batch of answers (query_id, query, documents, answer)."""
    steps = [("rewrite", F.col("query")), ("documents", F.to_json("documents")), ("answer", F.col("answer")), ("done", F.lit(""))]
    lines = F.array(*[F.struct(F.lit(i).alias("seq"), F.concat(F.lit("data: "), F.to_json(F.struct(F.lit(kind).alias("type"), value.alias("data"))), F.lit("\n\n")).alias("event")) for i, (kind, value) in enumerate(steps)])
    return answers.select("query_id", F.explode(lines).alias("e")).select("query_id", "e.seq", "e.event")
