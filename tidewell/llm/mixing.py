"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token weights of the cells source x language x topic are raked in turn to the target share of every
source, language and topic. A document is kept with the probability min(1, l * raked / own tokens)
of its cell, where l makes the expected tokens kept the asked share of all; the draw is a hash of
the id, so it is the same on every run. DataFrame functions only.

Nulls are a category of their own; null and empty texts have no tokens, and take their
cell's probability; a cell without tokens has probability 1 (it costs nothing). Repeated ids share one
draw; ``keep_sampled`` keeps all rows of an id of which any is sampled, and null is an id. Targets
that name no category present leave that dimension as it is; named categories that are not there
are dropped and the others scaled up; categories that a given target does not name get weight 0.
An empty table gives an empty result. Other columns pass through and may have any name but ``_tw_*``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Cells up to this many rows are sent to every executor and raked by one task; more shuffle.
MOST_BROADCAST = 100_000


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: str) -> Column:
    """A number in [0, 1) that only depends on the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def _category(df: DataFrame, name: str) -> Column:
    """The category with a sign before it; null as the empty string, which no category is then."""
    return F.coalesce(F.concat(F.lit("="), df[name].cast("string")), F.lit(""))


def targets_of(cells: DataFrame, dim: str, alpha: float, given: dict[str, float] | None) -> DataFrame:
    """(category, share) of one dimension: as given, or the category's own share to the power alpha."""
    spark = cells.sparkSession
    own = cells.groupBy(dim).agg(F.sum("tokens").alias("_t")).where("_t > 0")
    if given is not None:
        asked = spark.createDataFrame([("" if k is None else f"={k}", float(v)) for k, v in given.items()] or [("", 0.0)], f"`{dim}` string, _w double")
        raw = own.join(asked, dim, "left").select(dim, F.coalesce("_w", F.lit(0.0)).alias("_raw"))
        if (raw.agg(F.sum("_raw")).first()[0] or 0) <= 0:
            raw = own.select(dim, F.col("_t").cast("double").alias("_raw"))
    else:
        total = own.agg(F.sum("_t")).first()[0] or 1
        raw = own.select(dim, F.pow(F.col("_t") / F.lit(float(total)), F.lit(alpha)).alias("_raw"))
    raw = saved(raw)
    whole = raw.agg(F.sum("_raw")).first()[0] or 1.0
    return raw.select(dim, (F.col("_raw") / F.lit(float(whole))).alias(f"_share_{dim}"))


def rake(cells: DataFrame, dims: list[str], alpha: float, targets: dict[str, dict[str, float]] | None, rounds: int, every: int = 4, most: int = MOST_BROADCAST) -> DataFrame:
    """``cells`` with the raked share of all tokens in ``raked``.

    Up to ``most`` cells, of however many documents, are a small table: one task has them, and no sum shuffles.
    """
    few = cells.count() <= most
    cells = cells.coalesce(1) if few else cells
    for dim in dims:
        cells = cells.join(targets_of(cells, dim, alpha, (targets or {}).get(dim)), dim, "left")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = saved(cells.withColumn("raked", F.col("tokens") / F.lit(float(total))))
    cells = cells.coalesce(1) if few else cells
    for i in range(rounds):
        for dim in dims:
            have = F.sum("raked").over(Window.partitionBy(dim))
            cells = cells.withColumn("raked", F.when(have > 0, F.col("raked") * F.coalesce(f"_share_{dim}", F.lit(0.0)) / have).otherwise(F.lit(0.0)))
        if i % every == every - 1 or i == rounds - 1:
            cells = saved(cells)
            cells = cells.coalesce(1) if few else cells
    return cells


def calibrate(cells: DataFrame, keep: float, rounds: int = 12) -> DataFrame:
    """``cells`` with ``weight`` (raked over own share of tokens) and ``prob``.

    The multiplier comes from a few rounds of sums over cells: cells whose probability would pass 1
    are taken whole and the rest is scaled to what is left.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = saved(cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") * F.lit(float(total)) / F.col("tokens")).otherwise(F.lit(0.0))))
    scale = keep
    for _ in range(rounds):
        whole = F.lit(scale) * F.col("weight") >= 1
        row = cells.agg(F.sum(F.when(whole, F.col("tokens"))).alias("t"), F.sum(F.when(~whole, F.col("weight") * F.col("tokens"))).alias("w")).first()
        left = keep * total - (row["t"] or 0)
        if not row["w"] or left <= 0:
            break
        new = left / row["w"]
        if new == scale:
            break
        scale = new
    return cells.withColumn("prob", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(float(scale)) * F.col("weight"))).otherwise(F.lit(1.0)))


def mix(docs: DataFrame, dims: tuple[str, str, str] = ("source", "lang", "topic"), doc_id: str = "doc_id", text: str = "text", alpha: float = 0.7, keep: float = 0.8, targets: dict[str, dict[str, float]] | None = None, rounds: int = 12, tokens: str | None = None) -> DataFrame:
    """``docs`` with ``_tw_tokens, _tw_weight, _tw_prob, _tw_sampled``.

    tokens: a column with the number of tokens, where ``docs`` come without their text.

    targets: dimension -> category -> weight; a dimension without one is flattened: each category's
    share of tokens to the power ``alpha``. keep: share of all tokens that is kept in expectation.
    """
    names = [f"_tw_{i}" for i in range(len(dims))]
    rows = docs.withColumns({n: _category(docs, d) for n, d in zip(names, dims, strict=True)}).withColumn("_tw_tokens", F.col(tokens).cast("long") if tokens else tokens_of(text_of(docs, text)))
    cells = saved(rows.groupBy(*names).agg(F.sum("_tw_tokens").alias("tokens")))
    raked = rake(cells, names, alpha, {f"_tw_{i}": targets[d] for i, d in enumerate(dims) if d in targets} if targets else None, rounds)
    cells = saved(calibrate(raked, keep).select(*names, F.col("weight").alias("_tw_weight"), F.col("prob").alias("_tw_prob")))
    joined = rows.join(F.broadcast(cells) if cells.count() <= MOST_BROADCAST else cells, names)
    return joined.withColumn("_tw_sampled", draw(doc_id) < F.col("_tw_prob")).drop(*names)


def keep_sampled(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", most_ids: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` whose id ``mixed`` has sampled; the ids travel whole only up to ``most_ids``."""
    sampled = saved(mixed.where("_tw_sampled").select(F.col(doc_id).alias("_tw_id")).distinct())
    ids = F.broadcast(sampled) if sampled.count() <= most_ids else sampled
    return docs.join(ids, docs[doc_id].eqNullSafe(ids["_tw_id"]), "left_semi")


def with_topics(docs: DataFrame, topics: DataFrame, doc_id: str = "doc_id", key: str = "vec_id", label: str = "label") -> DataFrame:
    """``docs`` with ``topic``: the label of the row of ``topics`` with the document's id, the smallest where it repeats."""
    known = topics.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_tw_key")).agg(F.min(label).cast("string").alias("topic"))
    return docs.join(known, docs[doc_id] == known["_tw_key"], "left").drop("_tw_key")


def sql(alpha: float = 0.7, keep: float = 0.8, rounds: int = 12) -> str:
    """The same in SQL, rounds written out."""
    ctes = [
        "docs AS (SELECT d.doc_id, coalesce(source, '(null)') s, coalesce(lang, '(null)') l, coalesce(t.topic, '(null)') t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) n"
        " FROM documents d LEFT JOIN (SELECT vec_id, CAST(min(label) AS VARCHAR) topic FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1) t ON d.doc_id = t.vec_id)",
        "cells AS (SELECT s, l, t, CAST(sum(n) AS DOUBLE) n FROM docs GROUP BY ALL)",
    ]
    for d in "slt":
        ctes.append(f"p{d} AS (SELECT {d}, pow(sum(n) / (SELECT sum(n) FROM cells), {alpha}) w FROM cells GROUP BY {d} HAVING sum(n) > 0), q{d} AS (SELECT {d}, w / (SELECT sum(w) FROM p{d}) share_{d} FROM p{d})")
    ctes.append("r0 AS MATERIALIZED (SELECT *, n / (SELECT sum(n) FROM cells) r FROM cells LEFT JOIN qs USING (s) LEFT JOIN ql USING (l) LEFT JOIN qt USING (t))")
    k = 0
    for _ in range(rounds):
        for d in "slt":
            ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(r) OVER (PARTITION BY {d}) > 0 THEN r * coalesce(share_{d}, 0) / sum(r) OVER (PARTITION BY {d}) ELSE 0 END AS r) FROM r{k})")
            k += 1
    ctes.append(f"w AS MATERIALIZED (SELECT s, l, t, n, CASE WHEN n > 0 THEN r * (SELECT sum(n) FROM cells) / n ELSE 0 END w FROM r{k})")
    ctes.append(f"k0 AS MATERIALIZED (SELECT CAST({keep} AS DOUBLE) k)")
    for i in range(12):
        ctes.append(f"k{i + 1} AS MATERIALIZED (SELECT CASE WHEN b > 0 AND a > 0 THEN a / b ELSE k END k FROM (SELECT any_value(k) k, {keep} * sum(n) - coalesce(sum(n) FILTER (k * w >= 1), 0) a, sum(w * n) FILTER (k * w < 1) b FROM w, k{i}))")
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, s AS source, l AS lang, t AS topic, docs.n AS n_tokens, round(w, 6) AS weight, round(p, 6) AS prob,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 < p AS sampled
FROM docs JOIN (SELECT s, l, t, w, CASE WHEN n > 0 THEN least(1.0, k * w) ELSE 1.0 END p FROM w, k12) USING (s, l, t)
"""
