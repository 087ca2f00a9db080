"""Metrics of answers by aligned sentences, and of hits by their ranks.

A text's statements are its sentences, as sets of tokens. A sentence of a retrieved text supports a
statement if it has at least ``percent`` of the statement's tokens. One sentence may support several
statements, as one source may bear out two claims, so every statement is aligned with whatever supports
it and no one-to-one matching is sought.

Statements and sentences meet by query and token, and what they share is counted on both sides of one
shuffle; texts do not travel with the pairs. Null and empty texts have no statements and support
nothing; repeated sentences are statements of their own; a metric without anything to measure is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SENTENCE_BREAK = r"[.!?。！？\n]+"


def sentences(text: Column) -> Column:
    """The sentences of a text that have tokens, each as its distinct tokens."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.array_distinct(T.tokens(s)))
    return F.filter(parts, lambda t: F.size(t) > 0)


def statements(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, no, n, term): the tokens of each statement, with the statement's number and how many it has."""
    cut = rows.select(*keys, F.posexplode(sentences(F.col(text))).alias("no", "_terms"))
    return cut.select(*keys, "no", F.size("_terms").alias("n"), F.explode("_terms").alias("term"))


def supported(claims: DataFrame, hits: DataFrame, percent: int = 60) -> DataFrame:
    """(query_id, kind, no, rank) of the ``statements`` of claims by (query_id, kind) that a sentence of
    the hit of that rank (query_id, rank, text) supports, once each."""
    said = statements(hits, ["query_id", "rank"], "text").select("query_id", "rank", F.col("no").alias("_s"), "term")
    shared = claims.join(said, ["query_id", "term"]).groupBy("query_id", "kind", "no", "rank", "_s").agg(F.count(F.lit(1)).alias("_k"), F.first("n").alias("_n"))
    return shared.where(F.col("_k") * 100 >= F.col("_n") * percent).select("query_id", "kind", "no", "rank").distinct()


def metrics(answers: DataFrame, hits: DataFrame, percent: int = 60) -> DataFrame:
    """(query_id, faithfulness, context_recall, context_precision) of answers (query_id, response, reference).

    faithfulness: the share of the response's statements that hits support. context_recall: that of the
    reference's. context_precision: average precision of the hits in their order, where a hit counts if it
    supports a statement of the reference.
    """
    told = answers.select("query_id", F.explode(F.create_map(F.lit("response"), F.col("response"), F.lit("reference"), F.col("reference"))).alias("kind", "_text"))
    sizes = told.select("query_id", "kind", F.size(sentences(F.col("_text"))).alias("_of"))
    found = supported(statements(told, ["query_id", "kind"], "_text"), hits, percent)
    borne = found.groupBy("query_id", "kind").agg(F.count_distinct("no").alias("_in"))
    share = F.when(F.col("_of") > 0, F.coalesce("_in", F.lit(0)) / F.col("_of")).otherwise(F.lit(0.0))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, share))
    shares = sizes.join(borne, ["query_id", "kind"], "left").groupBy("query_id").agg(of("response").alias("faithfulness"), of("reference").alias("context_recall"))
    useful = found.where("kind = 'reference'").select("query_id", "rank").distinct()
    nth = useful.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    precision = nth.groupBy("query_id").agg(F.avg(F.col("_nth") / F.col("rank")).alias("context_precision"))
    return shares.join(precision, "query_id", "left").fillna(0.0, ["context_precision"])
