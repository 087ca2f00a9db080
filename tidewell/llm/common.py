"""Helpers shared by the corpus operators: shared-folder tables, packed arrays, word hashes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Where a local session names no spark.checkpoint.dir: one folder a process.
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session names none, a temporary one. On a
    cluster a setting is needed, as its machines share no temporary folder."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidewell-")
    return _own_dir


def saved(df: DataFrame, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, a folder for each value of ``by``, and read back.

    This cuts the lineage and survives lost executors; the table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression, partitionBy=by)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def saved_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """The union of one or more tables, each made and written before the next is asked for."""
    path = schema = spark = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_dir(spark)}/tidewell/{uuid.uuid4().hex}"
            atexit.register(_remove, spark, path)
        df.write.mode("append").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``saved`` that nothing will read again, and lets Spark drop the shuffle files
    of finished jobs, which it does when the driver's JVM collects what refers to them."""
    for df in tables:
        _remove(df.sparkSession, _paths[id(df)])
    for df in tables[:1]:
        release(df.sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs now."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the gateway is already gone
        return


def fetched(df: DataFrame) -> Iterator[Row]:
    """The rows of a bounded table, a part at a time on the driver. A part is a job, so there are no more of
    them than cores, whatever the number of partitions."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism).toLocalIterator()


def text_of(df: DataFrame, text: str):
    """The text column with null as the empty string."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def hashed_share(column: str, wanted: int, rows: int):
    """A condition that holds, by a hash of the column, for about ``wanted`` of ``rows`` rows."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, wanted / max(rows, 1))))


def join_by_size(left: DataFrame, right: DataFrame, on: str, rows: str, total: int, small: bool = False) -> DataFrame:
    """The inner join on a key that ``right`` has once for each value, with the number of its rows in
    ``left`` in the column ``rows``: keys with more than a thousandth of ``total`` rows, of which there
    are fewer than a thousand, are broadcast, all others shuffle; all are broadcast where ``right`` is small."""
    if small:
        return left.join(F.broadcast(right.drop(rows)), on)
    often = F.col(rows) > max(1000, total // 1000)
    hot = F.broadcast(saved(right.where(often).drop(rows)))
    rest = left.join(hot.select(on), on, "left_anti").join(right.where(~often).drop(rows), on)
    return left.join(hot, on).unionByName(rest)


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words (SipHash, as pandas has it); the same in every process."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()
