"""The numbered queries of the corpus operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, pieces
from .ann import search
from .common import text_of
from .exact_dedup import duplicate_table
from .hard_negatives import mine
from .hmm import score_documents
from .html_main import extract
from .jaccard_join import join_documents
from .quality import score_quality, train_quality
from .repeats import without_repeats
from .runs import with_runs
from .toxicity import THRESHOLD, score_toxicity, train_toxicity
from .url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % folds


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", "lang", mixing.tokens_of(text_of(docs, "text")).alias("n_tokens"))
    slim = mixing.with_topics(slim, table(spark, sf_dir, "embeddings"))
    category = {c: F.coalesce(c, F.lit("(null)")).alias(c) for c in ("source", "lang", "topic")}
    return mixing.mix(slim, tokens="n_tokens").select("doc_id", *category.values(), F.col("_tw_tokens").alias("n_tokens"), F.round("_tw_weight", 6).alias("weight"), F.round("_tw_prob", 6).alias("prob"), F.col("_tw_sampled").alias("sampled"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_tw_id").alias("doc_id"), "keep_id", "group_size", F.col("_tw_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_tw_sha").alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def _scored(scored: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), F.col("_tw_score").alias("score"), (F.col("_tw_score") >= threshold).cast("int").alias("predicted"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", text_of(docs, "text").alias("text"))
    coded = docs.select("doc_id", "text", pieces.coder(spark, most=4)("text").alias("c"))
    return coded.select("doc_id", F.size("c.ids").cast("long").alias("n_pieces"), F.element_at("c.scores", 1).alias("score"), F.col("c.scores").alias("path_scores"), F.col("c.ids").alias("piece_ids"), F.col("c.paths").alias("path_ids"), F.col("c.decoded").alias("decoded"), (F.col("c.decoded") == F.col("text")).alias("round_trip"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold_of("doc_id", 4) != 2)
    return _scored(score_toxicity(docs, model), 4, 2, THRESHOLD)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), fold_of("doc_id", 5) != 0)
    return _scored(score_quality(docs, model), 5, 0, THRESHOLD)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold_of("doc_id", 10) == 0
    scored = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held)
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("_tw_text").alias("text"), F.length("_tw_text").cast("long").alias("n_chars"))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return pages.select("page_id", F.col("_tw_host").alias("host"), F.col("_tw_path").alias("path"), F.col("_tw_rule").alias("rule"), F.col("_tw_verdict").alias("verdict"), F.round("_tw_score", 6).alias("margin"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    x = F.col("embedding")
    good = ~F.exists(x, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(x.isNotNull() & good).select("vec_id", label.alias("label"), F.transform(x, lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return mine(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id, text: of one document in ten, by crc32 of the id, the words from one on repeat with a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g, words = F.floor(h / 10).cast("int"), F.filter(F.split(text_of(docs, "text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", text_of(docs, "text").alias("text"), (h % 10 == 0).alias("chosen"), g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + CAST(FLOOR((n - a) / (3 + g % 8)) AS INT)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> element_at(w, 1 + IF(i < a, i, a + (i - a) % p))), ' ')")
    return rows.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(repeating(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rows = found.select(F.col("_tw_id").alias("doc_id"), F.col("_tw_runs").alias("n_runs"), F.col("_tw_start").alias("start"), F.col("_tw_length").alias("length"), F.col("_tw_period").alias("period"), F.col("_tw_runs_sha").alias("runs_sha256"), F.col("_tw_collapsed_sha").alias("collapsed_sha256"))
    return rows.withColumn("exponent_milli", F.floor(F.col("length") * 1000 / F.col("period")))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select(F.col("_tw_id").alias("doc_id"), F.col("_tw_bytes").alias("n_bytes"), F.col("_tw_removed").alias("n_removed"), F.col("_tw_spans").alias("n_spans"), F.col("_tw_kept_sha").alias("kept_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS times FROM w) WHERE times > 1),
b AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS begins FROM s),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b) GROUP BY ALL),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS left_hex FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(left_hex, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.sql(), "op2_exact_dedup": OP2_SQL, "op11_hard_negatives": OP11_SQL, "op13_suffix_dedup": OP13_SQL}
