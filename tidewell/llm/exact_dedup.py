"""Exact dedup in two passes of a Bloom filter.

Pass one: every task marks the bits of its rows' 64-bit text hashes and sends, by block of the bit
table, the offsets marked once and more than once; a block's merge keeps the bits that were marked
at least twice over all rows. Pass two: a row whose bits are not all among them has a text that no
other row has, and passes straight through; only the others shuffle, to be grouped by the SHA-256
of the text. False positives cost a shuffle of that row and nothing else.

The bit table has ``BITS_PER_ROW`` bits a row up to ``most_bits``, which bounds what is broadcast and
what a Python worker holds. Beyond that the hash space is cut into slices: the (id, hash) table is
written once more, a folder a slice, without a shuffle. The slices are taken one after the other: a
slice's table is built from its own folder, its rows are flagged and written, and the table is given up
before the next. So each row of the (id, hash) table is read three times, however many slices there are.

Null text counts as empty; very long texts only move as hashes; the text is not changed before
comparison. Equal texts: the row with the largest id stays, a null id below all others. Rows that
repeat an id and a text are one group; ``exact_dedup`` keeps one of them. An empty table gives an
empty result. Other columns pass through and may have any name but ``_tw_*``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fetched, mix64, saved, saved_parts, text_of

BITS_PER_ROW = 16
HASHES = 2
BLOCK_BITS = 1 << 16
#: A table of 256 MB, for 130 million rows.
MOST_BITS = 1 << 31


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit numbers of each hash; ``bits`` is a power of two."""
    first = mix64(hashes)
    return [((first + np.uint64(i) * (mix64(first ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1))) >> np.uint64(8)) & np.uint64(bits - 1) for i in range(HASHES)]


def _by_block(bits: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted bit numbers as 16-bit offsets by block of 65,536."""
    blocks, starts = np.unique(bits >> np.uint64(16), return_index=True)
    for block, part in zip(blocks.tolist(), np.split((bits & np.uint64(0xFFFF)).astype(np.uint16), starts[1:]), strict=True):
        yield block, part.tobytes()


def repeated_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """The table of bits that the column ``h`` (long) of ``hashes`` marks at least twice."""

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def out(parts):
            bit, n = np.unique(np.concatenate(parts), return_counts=True)
            rows = [(b, x, m) for m, some in ((1, bit[n == 1]), (2, bit[n > 1])) if len(some) for b, x in _by_block(some)]
            return pa.record_batch({"block": pa.array([r[0] for r in rows], pa.int64()), "places": pa.array([r[1] for r in rows], pa.binary()), "times": pa.array([r[2] for r in rows], pa.int32())})

        for batch in it:
            if not batch.num_rows:
                continue
            found = _places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits)
            # a row marks each bit once, or rows whose two bits agree would seem repeated
            found[1] = found[1][found[1] != found[0]]
            parts += found
            waiting += batch.num_rows
            if waiting >= 2_000_000:
                yield out(parts)
                parts, waiting = [], 0
        if parts:
            yield out(parts)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        marked = np.zeros(BLOCK_BITS, dtype=np.uint8)
        for places, times in zip(group["places"], group["times"], strict=True):
            at = np.frombuffer(places, dtype=np.uint16)
            marked[at] = np.minimum(marked[at] + times, 2)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "table": [np.packbits(marked >= 2).tobytes()]})

    table = np.zeros(bits // 8, dtype=np.uint8)
    merged = hashes.select("h").mapInArrow(mark, "block long, places binary, times int").groupBy("block").applyInPandas(merge, "block long, table binary")
    size = min(BLOCK_BITS, bits) // 8
    for row in fetched(merged):
        table[row["block"] * (BLOCK_BITS // 8) :][:size] = np.frombuffer(row["table"], dtype=np.uint8)[:size]
    return table


def repeated_filter(hashes: DataFrame, bits: int):
    """Pass one over the column ``h``: (a function of a hash column that is true for every hash that
    occurs twice and false for nearly all others, the broadcast table that it needs)."""
    shared = hashes.sparkSession.sparkContext.broadcast(repeated_bits(hashes, bits))

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        table = shared.value
        hit = np.ones(len(h), dtype=bool)
        for place in _places(h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
            hit &= (table[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return pa.array(hit)

    return maybe, shared


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs with ``_tw_sha`` and the Bloom key ``_tw_h``."""
    return docs.withColumn("_tw_sha", F.sha2(text_of(docs, text), 256)).withColumn("_tw_h", F.xxhash64("_tw_sha"))


def slicing(rows: int, most_bits: int) -> tuple[int, int]:
    """(bits of a slice's table, slices) for so many rows; both are powers of two."""
    bits = 1 << max(16, (max(rows, 1) * BITS_PER_ROW - 1).bit_length())
    slices = max(1, bits // most_bits)
    return bits // slices, slices


def by_slice(keyed: DataFrame, slices: int) -> list[DataFrame]:
    """``keyed`` by slices of its hashes. Each reads the folder of its slice only; as few tasks as keep
    all cores at work write them, as each writes a file a slice."""
    if slices == 1:
        return [keyed]
    tasks = 4 * keyed.sparkSession.sparkContext.defaultParallelism
    cut = saved(keyed.withColumn("_tw_slice", F.pmod(F.shiftright("_tw_h", 40), F.lit(slices)).cast("int")).coalesce(tasks), by="_tw_slice")
    return [cut.where(F.col("_tw_slice") == i).drop("_tw_slice") for i in range(slices)]


def flagged(keyed: DataFrame, rows: int, most_bits: int) -> DataFrame:
    """``keyed`` with ``_tw_maybe`` in place of ``_tw_h``, written; one slice's table is held at a time."""
    bits, slices = slicing(rows, most_bits)

    def parts() -> Iterator[DataFrame]:
        for own in by_slice(keyed, slices):
            maybe, table = repeated_filter(own.select(F.col("_tw_h").alias("h")), bits)
            yield own.withColumn("_tw_maybe", maybe(F.col("_tw_h"))).drop("_tw_h")
            table.destroy()

    return saved_parts(parts())


def _groups(flagged: DataFrame, keep: str = "max") -> DataFrame:
    first = F.max("_tw_id") if keep == "max" else F.min_by("_tw_id", F.struct("_tw_id"))
    return saved(flagged.groupBy("_tw_sha").agg(first.alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def duplicate_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, keep: str = "max") -> DataFrame:
    """One row per document: ``_tw_id, _tw_sha, keep_id, group_size, _tw_passed``.

    ``_tw_passed`` marks rows that the filter let through without a shuffle.
    """
    keyed = saved(_keyed(docs, doc_id, text).select(docs[doc_id].alias("_tw_id"), "_tw_sha", "_tw_h"))
    rows = keyed.count()
    every = flagged(keyed, rows, most_bits)
    alone = every.where(~F.col("_tw_maybe")).select("_tw_id", "_tw_sha", F.col("_tw_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("_tw_passed"))
    again = every.where("_tw_maybe").select("_tw_id", "_tw_sha")
    groups = _groups(again, keep)
    # at most a thousand groups can hold more than a thousandth of the rows each: those are
    # broadcast, so that no group's rows meet in one task
    large = F.col("group_size") > F.lit(max(1000, rows // 1000))
    hot = again.join(F.broadcast(groups.where(large)), "_tw_sha")
    rest = again.join(F.broadcast(groups.where(large).select("_tw_sha")), "_tw_sha", "left_anti").join(groups.where(~large), "_tw_sha")
    cols = ["_tw_id", "_tw_sha", "keep_id", "group_size", F.lit(False).alias("_tw_passed")]
    return alone.unionByName(hot.select(*cols)).unionByName(rest.select(*cols))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS, keep: str = "max", most_ids: int = 1 << 20) -> DataFrame:
    """``docs`` without the rows whose text a row with a larger id has; columns as they were.

    With ``keep="min"`` the row with the smallest id stays instead (a null id if the group has one).

    Rows that the filter clears never shuffle; of the others only the row that stays does. Where the
    filter has several slices, which no task can hold together, the rows that leave are found on the
    (id, hash) table and taken out by their ids and hashes, broadcast up to ``most_ids`` of them.
    """
    keyed = saved(_keyed(docs, doc_id, text).select(docs[doc_id].alias("_tw_id"), "_tw_sha", "_tw_h"))
    n = keyed.count()
    bits, slices = slicing(n, most_bits)
    rows = _keyed(docs, doc_id, text)
    if slices == 1:
        maybe, _ = repeated_filter(keyed.select(F.col("_tw_h").alias("h")), bits)
        again = keyed.where(maybe(F.col("_tw_h")))
        rows = rows.withColumn("_tw_maybe", maybe(F.col("_tw_h")))
    else:
        again = flagged(keyed, n, most_bits).where("_tw_maybe")
        hashes = again.select("_tw_sha").distinct()
        hashes = F.broadcast(hashes) if hashes.count() <= most_ids else hashes
        rows = rows.join(hashes.withColumn("_tw_maybe", F.lit(True)), "_tw_sha", "left").withColumn("_tw_maybe", F.col("_tw_maybe").isNotNull())
    keepers = _groups(again, keep).select(F.col("_tw_sha").alias("_tw_s"), F.col("keep_id").alias("_tw_k"))
    through = rows.where(~F.col("_tw_maybe")).select(docs.columns)
    stay = rows.where("_tw_maybe").join(keepers, (F.col("_tw_sha") == F.col("_tw_s")) & F.col(doc_id).eqNullSafe(F.col("_tw_k")), "left_semi")
    return through.unionByName(stay.dropDuplicates(["_tw_sha", doc_id]).select(docs.columns))
