"""Sessions as streaming state: the memory of a dialogue, its events in order, and a sink that replays leave alone.

State is kept by ``transformWithState`` in RocksDB, checkpointed with the stream, so a restart goes on where the
last batch ended. A message that comes again, or after a later one of its session, changes nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEMORY = "session_id string, seq long, kept long, folds long, running string, history string"
EVENTS = "session_id string, event_no long, seq long, event string"


def reference(prompt: str) -> str:
    """A stand-in for a model whose reply changes with every character of the prompt."""
    return "ref " + hashlib.md5(prompt.encode()).hexdigest()


@dataclass(frozen=True)
class MemorySpec:
    """When history is folded: at ``threshold`` of ``max_tokens`` the oldest ``1 / cut_scale`` of the messages,
    two at least; state of a session goes ``ttl_ms`` after its last write (never, where it is 0). With such
    a time the stream must run on; a run over what is available does not end, as time may yet take state."""

    max_tokens: int = 1024
    threshold: float = 0.7
    cut_scale: int = 2
    ttl_ms: int = 0


class SessionMemory(StatefulProcessor):
    """Messages of a session that are not folded, in order, and the running summary of those that are.

    Before a user's message is added, the history is folded if it has grown too long: the summary of
    the oldest messages becomes a further line of the running one. Every message gives a row with the
    memory as the next turn finds it.
    """

    def __init__(self, spec: MemorySpec, summarise: Callable[[str], str]):
        self.spec, self.summarise = spec, summarise

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.spec.ttl_ms or None
        self.messages = handle.getListState("messages", "seq long, role string, content string", ttl)
        self.summary = handle.getValueState("summary", "last long, folds long, running string", ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  Spark's names
        """A session's memory from elsewhere: (session_id, running, last)."""
        row = initialState.iloc[0]
        self.summary.update((int(row["last"]), 0, row["running"] or ""))

    def _known(self) -> tuple[list[tuple], int, int, str]:
        last, folds, running = self.summary.get() if self.summary.exists() else (-1, 0, "")
        return [tuple(m) for m in self.messages.get()] if self.messages.exists() else [], last, folds, running

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, last, folds, running = self._known()
        out = []
        for m in sorted((m for part in rows for m in part[["seq", "role", "content"]].itertuples(index=False)), key=lambda m: m.seq):
            if m.seq <= last:
                continue
            tokens = sum(-(-len(x[2]) // 4) for x in kept)
            if m.role == "user" and kept and tokens >= self.spec.max_tokens * self.spec.threshold:
                cut = max(2, len(kept) // self.spec.cut_scale)
                told = self.summarise(T.template("summary").replace("{history}", "\n".join(x[2] for x in kept[:cut])))
                running, kept, folds = f"{running}\n{told}".strip(), kept[cut:], folds + 1
            kept.append((int(m.seq), m.role, m.content or ""))
            last = int(m.seq)
            out.append((key[0], last, len(kept), folds, running, "\n".join([*([running] if running else []), *(x[2] for x in kept)])))
        if out:
            self.messages.put(kept)
            self.summary.update((last, folds, running))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MEMORY.split(", ")])

    def close(self) -> None:
        pass


class SessionEvents(StatefulProcessor):
    """The event lines of a session, numbered on from batch to batch: a user's message is told as it was
    rewritten, an assistant's as an answer and an end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "last long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, n = self.told.get() if self.told.exists() else (-1, 0)
        out = []
        for m in sorted((m for part in rows for m in part[["seq", "role", "content"]].itertuples(index=False)), key=lambda m: m.seq):
            if m.seq <= last:
                continue
            kinds = {"user": [("rewrite", m.content)], "assistant": [("answer", m.content), ("done", "")]}.get(m.role, [("progress", m.content)])
            for kind, data in kinds:
                line = json.dumps({"type": kind, "data": data or ""}, ensure_ascii=False, separators=(",", ":"))
                out.append((key[0], n, int(m.seq), f"data: {line}\n\n"))
                n += 1
            last = int(m.seq)
        if out:
            self.told.update((last, n))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def close(self) -> None:
        pass


def session_memory(messages: DataFrame, spec: MemorySpec = MemorySpec(), summarise: Callable[[str], str] = reference, known: DataFrame | None = None) -> DataFrame:
    """MEMORY rows of a stream of (session_id, seq, role, content), one a message; ``known`` holds memories
    (session_id, running, last) to start from."""
    first = known.groupBy("session_id") if known is not None else None
    return messages.groupBy("session_id").transformWithStateInPandas(SessionMemory(spec, summarise), MEMORY, "Append", "ProcessingTime" if spec.ttl_ms else "None", first)


def session_events(messages: DataFrame) -> DataFrame:
    """EVENTS rows of a stream of (session_id, seq, role, content)."""
    return messages.groupBy("session_id").transformWithStateInPandas(SessionEvents(), EVENTS, "Append", "None")


class EpochSink:
    """A table under a path with a folder for each micro-batch, which is overwritten whenever the batch comes
    again; so a replay after a failure adds no row, and readers see whole batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, epoch long").option("basePath", self.path).parquet(self.path)

    def start(self, rows: DataFrame, checkpoint: str, available_now: bool = True):
        """Starts the query that feeds this sink, with state in RocksDB unless the session names another store."""
        if not self.spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        writer = rows.writeStream.outputMode("append").foreachBatch(self.write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
