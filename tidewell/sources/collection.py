"""The collection: one wide table of records, written by overwrite, append, upsert and delete, and merged when it is read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..config import Mapping, Settings
from ..functions import text as T
from ..functions.vectors import hash_embedding
from .term_index import scratch

FIELDS = ["pk", "text", "summary", "document", "source", "source_name", "lt_doc_id", "chunk_id", "summary_dense", "text_dense"]


def shape_records(records: DataFrame, mapping: Mapping = Mapping()) -> DataFrame:
    """Records as collection rows without vectors; unmapped columns stay in the map ``extras``.

    A column that the mapping names but the table lacks takes the default; a null in one that is
    there becomes the empty string.
    """

    def field(name: str | None, default: str) -> Column:
        return T.to_text(F.col(f"`{name}`")) if name and name in records.columns else F.lit(default)

    summary, document = field(mapping.summary, ""), field(mapping.document, "")
    source, source_name = field(mapping.source, mapping.default_source), field(mapping.source_name, mapping.default_source_name)
    chunk = F.coalesce(F.col(f"`{mapping.chunk}`").cast("long"), F.lit(-1)) if mapping.chunk and mapping.chunk in records.columns else F.lit(-1).cast("long")
    used = {mapping.summary, mapping.document, mapping.source, mapping.source_name, mapping.parent, mapping.chunk}
    pairs = [x for c in records.columns if c not in used for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    extras = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return records.select(
        T.content_key(summary).alias("pk"),
        T.qa_text(source, summary, document).alias("text"),
        summary.alias("summary"),
        document.alias("document"),
        source.alias("source"),
        source_name.alias("source_name"),
        field(mapping.parent, "").alias("lt_doc_id"),
        chunk.alias("chunk_id"),
        extras.alias("extras"),
    )


def with_vectors(rows: DataFrame, dimension: int = 64, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fills ``summary_dense`` and ``text_dense`` where they are missing or empty."""
    embed = embed or (lambda c: hash_embedding(T.tokens(c), dimension))
    for name in ("summary", "text"):
        made = embed(F.col(name)).cast("array<float>")
        given = f"{name}_dense"
        rows = rows.withColumn(given, F.when(F.size(given) > 0, F.col(given)).otherwise(made) if given in rows.columns else made)
    return rows


def latest(rows: DataFrame, key: str = "pk", order: list[Column] | None = None) -> DataFrame:
    """One row a key: the last in order (by all columns where none is given, so that it is the same each time)."""
    order = order or [F.desc(c) for c, kind in rows.dtypes if not kind.startswith("map")]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def last_shaped(records: DataFrame, mapping: Mapping = Mapping()) -> DataFrame:
    """``shape_records`` with the last record of equal keys only. What is made of other columns is made after
    records have met by key, so that it is not shuffled with them."""
    slim = shape_records(records, mapping).drop("text").repartition("pk")
    rows = slim.withColumn("text", T.qa_text(F.col("source"), F.col("summary"), F.col("document")))
    return latest(rows.select("pk", "text", *[c for c in slim.columns if c != "pk"]))


def upserted(old: DataFrame, new: DataFrame, key: str = "pk", order: list[Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; within ``new`` the last row of a key counts.

    Only keys of ``new`` are shuffled against the old table; untouched rows are not compared by value.
    """
    fresh = latest(new, key, order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def deleted(rows: DataFrame, ids: DataFrame, key: str = "pk") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def chunks(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with ``batch``: consecutive batches of n by key (at least 1), the last one smaller.

    Ranks come from a range partitioning and the partitions' counts, not from one sorted task.
    """
    n = max(1, n)
    ranged = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return ranged.withColumn("_n", own).join(F.broadcast(counts), "_p").withColumn("batch", F.floor((F.col("_n") + F.col("_before") - 1) / n)).drop("_p", "_n", "_before")


@dataclass(frozen=True)
class Layout:
    """When a collection's buckets split and its layers merge."""

    #: Buckets at first, and rows in a bucket on the average beyond which one splits.
    buckets: int = 16
    bucket_rows: int = 1 << 20
    #: Layers over a bucket's first that are merged with each other, and the share of the first's rows
    #: beyond which they are merged into it.
    layers: int = 8
    share: float = 0.25


def bucket_of(count: int, first: int, key: str = "pk") -> Column:
    """The bucket of a key among ``count`` by linear hashing: of ``first`` buckets those before the next in
    line have split, so one more bit of the hash tells to which of two a key went."""
    h = F.xxhash64(F.col(key).cast("string"))
    before = F.pmod(h, F.lit(first))
    return F.when(before < count - first, F.pmod(h, F.lit(2 * first))).otherwise(before).cast("int")


def merged(rows: DataFrame) -> DataFrame:
    """Layers' rows (``_mark``, ``_row``, ``_seq``) as one layer: rows that no later mark replaces, and for keys that
    only have marks the mark; a row whose key is marked anywhere here is marked."""
    marks = rows.where("_mark").groupBy(F.col("pk").alias("_k")).agg(F.max("_seq").alias("_m"))
    both = rows.join(marks, F.col("pk") == F.col("_k"), "left")
    stay = both.where(F.col("_row") & (F.col("_m").isNull() | (F.col("_seq") >= F.col("_m")))).withColumn("_mark", F.col("_m").isNotNull())
    gone = both.where(~F.col("_row") & (F.col("_seq") == F.col("_m")))
    return stay.drop("_k", "_m").unionByName(gone.drop("_k", "_m"))


class Collection:
    """A collection stored under one path, by bucket of its key's hash, merged when it is read.

    A bucket is a list of layers, oldest first; a layer is the files of one write. Every write puts its rows
    into a folder of its own, ``data/<name>/bucket=k``, and then a manifest, ``versions/v<n>``, that adds
    the folder to the layers of its buckets. No write reads or moves the rows that are there: an
    upsert's rows are marked as replacing older layers' rows of their keys, a delete is such marks alone,
    an insert has none. Readers let a row through unless a later layer has a mark of its key.

    Layers over a bucket's first one are merged with each other when there are ``layers`` of them, and
    into the first when they hold more than ``share`` of its rows, so a row is rewritten a few times
    however many writes follow. Buckets split by linear hashing: with more than ``bucket_rows`` rows a bucket on the
    average, the next bucket in line is dealt to two, one hash bit further, and the others stay as they are.

    A manifest is written once, by whoever is first, so of two writers at the same time one fails
    instead of undoing the other's change; a reader sees a version whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), buckets: int = 16, layout: Layout | None = None):
        self.spark, self.path, self.settings, self.layout = spark, path.rstrip("/"), settings, layout or Layout(buckets)

    def _at(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        fs, at = self._at("versions")
        return max((int(s.getPath().getName()[1:]) for s in fs.listStatus(at)), default=-1) if fs.exists(at) else -1

    def _manifest(self) -> dict:
        """version; schema; count, the number of buckets; first, their number when it was a power of two
        times the number at first; buckets: the layers [name, rows, version] of each."""
        n = self.version()
        if n < 0:
            return {"version": -1, "schema": None, "count": self.layout.buckets, "first": self.layout.buckets, "buckets": {}}
        row = self.spark.read.option("wholetext", True).text(f"{self.path}/versions/v{n}").first()
        return json.loads(row["value"])

    def _commit(self, old: dict, schema: StructType, buckets: dict[str, list[list]], count: int = 1, first: int = 1) -> None:
        version = old["version"] + 1
        fs, at = self._at(f"versions/v{version}")
        out = fs.create(at, False)  # fails where another writer was first
        out.write(json.dumps({"version": version, "schema": schema.jsonValue(), "count": count, "first": first, "buckets": buckets}).encode())
        out.close()

    def _put(self, rows: DataFrame, manifest: dict, marked: bool = False, plain: bool = True) -> tuple[str, dict[str, int]]:
        """Writes rows into a folder of their own; its name and the number of rows in each bucket.

        marked: the rows replace those of their keys in older layers; plain: they are rows, and not marks alone.
        """
        name = uuid.uuid4().hex
        if "_mark" not in rows.columns:
            rows = rows.withColumns({"_mark": F.lit(marked), "_row": F.lit(plain)})
        rows.withColumn("bucket", bucket_of(manifest["count"], manifest["first"])).write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        fs, at = self._at(f"data/{name}")
        found = [s.getPath().getName()[7:] for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")]
        counts = {str(r["bucket"]): r["count"] for r in self.spark.read.parquet(f"{self.path}/data/{name}").groupBy("bucket").count().collect()} if found else {}
        return name, counts

    def _layers(self, manifest: dict, buckets: dict[str, list[list]]) -> DataFrame:
        """The rows of these layers with ``_mark``, ``_row`` and ``_seq``, the version of their layer."""
        schema = StructType.fromJson(manifest["schema"])
        stored = StructType([*schema.fields, StructField("_mark", BooleanType()), StructField("_row", BooleanType())])
        folders: dict[tuple[int, str], list[str]] = {}
        for b, layers in buckets.items():
            for name, _, seq in layers:
                folders.setdefault((seq, name), []).append(f"{self.path}/data/{name}/bucket={b}")
        parts = [self.spark.read.schema(stored).parquet(*paths).withColumn("_seq", F.lit(seq).cast("long")) for (seq, _), paths in sorted(folders.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], StructType([*stored.fields, StructField("_seq", LongType())]))

    def _rows(self, manifest: dict, buckets: dict[str, list[list]] | None = None) -> DataFrame:
        """What readers see of these buckets, all by default."""
        buckets = manifest["buckets"] if buckets is None else buckets
        names = StructType.fromJson(manifest["schema"]).names
        one = {b: x for b, x in buckets.items() if len(x) == 1}
        more = {b: x for b, x in buckets.items() if len(x) > 1}
        rows = self._layers(manifest, one).where("_row").select(*names)
        return rows.unionByName(merged(self._layers(manifest, more)).where("_row").select(*names)) if more else rows

    def read(self, fields: list[str] | None = None) -> DataFrame:
        """The newest version; an error where there is none."""
        manifest = self._manifest()
        if manifest["version"] < 0:
            raise FileNotFoundError(self.path)
        df = self._rows(manifest)
        return df.select(*fields) if fields else df

    def create(self, rows: DataFrame, drop_old: bool = True) -> bool:
        """Writes ``rows`` as the whole collection; an existing one is left alone unless ``drop_old``."""
        old = self._manifest()
        if old["version"] >= 0 and not drop_old:
            return False
        new = {"count": self.layout.buckets, "first": self.layout.buckets}
        name, counts = self._put(rows if "pk" in rows.columns else rows.withColumn("pk", F.lit(None).cast("string")), new)
        self._commit(old, rows.schema, {b: [[name, n, old["version"] + 1]] for b, n in counts.items()}, **new)
        self.compact()
        return True

    def _add(self, rows: DataFrame, marked: bool, plain: bool) -> None:
        """A layer over the buckets of these rows; columns that only one side has are null in the other."""
        old = self._manifest()
        schema = StructType.fromJson(old["schema"])
        more = [f for f in rows.schema.fields if f.name not in schema.names]
        name, counts = self._put(rows, old, marked, plain)
        buckets = {b: [*old["buckets"].get(b, []), *([[name, counts[b], old["version"] + 1]] if b in counts else [])] for b in {*old["buckets"], *counts}}
        self._commit(old, StructType([*schema.fields, *more]), buckets, old["count"], old["first"])
        self.compact()

    def insert(self, rows: DataFrame) -> None:
        """Adds rows, without a look at what is there."""
        if self.version() < 0:
            self.create(rows)
        else:
            self._add(rows, False, True)

    def upsert(self, rows: DataFrame, order: list[Column] | None = None, single: bool = False) -> None:
        """Adds rows in place of those with their keys; of equal keys in ``rows`` the last counts.

        single: ``rows`` has no key twice, so that none is looked for.
        """
        fresh = rows if single else latest(rows, order=order)
        if self.version() < 0:
            self.create(fresh)
        else:
            self._add(fresh, True, True)

    def delete(self, ids: DataFrame) -> None:
        self._add(ids.select("pk").distinct(), True, False)

    def compact(self, whole: bool = False) -> bool:
        """Merges layers and splits buckets where the layout asks for it, or merges all with ``whole``; whether
        there was anything to do. If another writer is first, its version stands and this work is left undone."""
        old, layout = self._manifest(), self.layout
        size = {b: sum(x[1] for x in layers) for b, layers in old["buckets"].items()}
        above = {b: sum(x[1] for x in layers[1:]) for b, layers in old["buckets"].items()}
        count, first = old["count"], old["first"]
        full = {b for b, layers in old["buckets"].items() if len(layers) > 1 and (whole or above[b] > layout.share * layers[0][1])}
        some = {b for b, layers in old["buckets"].items() if len(layers) > layout.layers and b not in full}
        total = sum(size.values())
        while total > count * layout.bucket_rows:
            full.add(str(count - first))  # the next in line
            count += 1
            if count == 2 * first:
                # all were split; the first of them are next, which may split once more
                first *= 2
        full &= old["buckets"].keys()
        some -= full
        if not full and not some:
            return False
        new = {"count": count, "first": first}
        buckets = {b: layers for b, layers in old["buckets"].items() if b not in full}
        version = old["version"] + 1
        if full:
            name, counts = self._put(self._rows(old, {b: old["buckets"][b] for b in full}), new)
            # a split bucket's rows are in one of two buckets, of which neither has other layers
            buckets |= {b: [[name, n, version]] for b, n in counts.items()}
        if some:
            rest = self._layers(old, {b: old["buckets"][b][1:] for b in some})
            name, counts = self._put(merged(rest).drop("_seq"), new)
            buckets |= {b: [old["buckets"][b][0], *([[name, counts[b], version]] if b in counts else [])] for b in some}
        try:
            self._commit(old, StructType.fromJson(old["schema"]), buckets, **new)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        return True

    def vacuum(self) -> int:
        """Removes the folders that the newest version does not name; how many."""
        named = {layer[0] for layers in self._manifest()["buckets"].values() for layer in layers}
        fs, at = self._at("data")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in named] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def ingest(self, records: DataFrame, drop_old: bool = True, batch: int | None = None, progress: Callable[[int, int], None] | None = None) -> int:
        """Shapes, embeds and writes records, the last of equal keys; the number of rows stored after.

        With ``batch`` and ``progress``, records are written in batches of so many by key and ``progress``
        is told the number written and the whole number after each.
        """
        rows = with_vectors(last_shaped(records, self.settings.mapping), self.settings.dimension)
        if drop_old or self.version() < 0:
            self.create(rows.limit(0) if batch else rows)
        elif not batch:
            self.upsert(rows, single=True)
        if batch:
            parts = scratch(chunks(rows, "pk", batch), "batch")
            total, done = parts.count(), 0
            for i in range(-(-total // batch)):
                self._add(parts.where(F.col("batch") == i).drop("batch"), True, True)
                done = min(total, done + batch)
                if progress:
                    progress(done, total)
        return self.read(["pk"]).count()
