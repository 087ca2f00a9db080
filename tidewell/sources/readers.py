"""Reading records, stop words, pages and event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines or Parquet, by the path's ending; anything else is an error."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in ("json", "jsonl", "parquet"):
        raise ValueError(f"cannot read {path}: neither JSON lines nor Parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path) if ending == "parquet" else reader.json(path)


def stream_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the files of a Parquet table: a folder of parts, or one file, which streams as the only
    one of its name in its folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def from_rows(spark: SparkSession, rows: list[dict], schema: StructType | str) -> DataFrame:
    """Records at hand as a table; names that the schema lacks are left out, missing ones are null."""
    return spark.createDataFrame(rows, schema)


def stop_words(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(word): the distinct blank-separated words of the files."""
    return spark.read.text(paths).select(F.explode(F.split("value", r"\s+")).alias("word")).where("word != ''").distinct()


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key; files have no order of their own."""
    return df.orderBy(key).limit(n)


def event_lines(lines: DataFrame, value: str = "value", schema: str = "type string, message string, data string, questions array<string>, queries array<string>", stream: str | None = None, order: str | None = None) -> DataFrame:
    """Server-sent events: the objects of the lines that start with ``data: ``; broken ones are dropped.

    With the columns ``stream`` and ``order`` what follows a stream's first ``done`` is left out, and
    both columns are kept.
    """
    kept = [c for c in (stream, order) if c]
    body = lines.where(F.col(value).startswith("data: ")).select(*kept, F.substring(value, 7, 1 << 30).alias("_j"))
    events = body.select(*kept, F.from_json("_j", schema).alias("e")).where("e.type is not null")
    if stream and order:
        end = F.min(F.when(F.col("e.type") == "done", F.col(order))).over(Window.partitionBy(stream))
        events = events.withColumn("_end", end).where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")
    return events.select(*kept, "e.*")


SEARCHES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_search(name: str, search: Callable[[DataFrame], DataFrame]) -> None:
    """A web search: queries (query_id, query, cnt) -> (query_id, rank, passage, url)."""
    SEARCHES[name] = search


def documents_of(result: Column) -> Column:
    """A tool's JSON array of records; invalid or empty text gives none."""
    return F.coalesce(F.from_json(result, "array<struct<passage: string, url: string>>"), F.array().cast("array<struct<passage: string, url: string>>"))
