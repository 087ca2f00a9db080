"""Corpus statistics and BM25 weights as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Bm25
from ..functions.text import counted, tokens
from .joins import by_size

#: Words of a table of stop words that are looked up as a set.
STOP_WORDS = 1 << 13


def tokenised(docs: DataFrame, key: str, text: str, stop_words: list[str] | DataFrame | None = None) -> DataFrame:
    """(key, tokens), without the stop words: a list, or a table (word).

    A table of up to ``STOP_WORDS`` distinct words goes to every row as a set of values, in which a token is looked
    up by its hash; of more words, as one array, which is gone through for each token.
    """
    words = F.coalesce(F.col(text), F.lit(""))
    if not isinstance(stop_words, DataFrame):
        return docs.select(F.col(key), tokens(words, stop_words).alias("tokens"))
    found = [r["word"] for r in stop_words.where("word is not null").select("word").distinct().limit(STOP_WORDS + 1).collect()]
    if len(found) <= STOP_WORDS:
        return docs.select(F.col(key), tokens(words, sorted(found)).alias("tokens"))
    stop = F.broadcast(stop_words.agg(F.collect_set("word").alias("_stop")))
    return docs.select(F.col(key), tokens(words).alias("_t")).join(stop, how="cross").select(key, F.filter("_t", lambda t: ~F.array_contains(F.col("_stop"), t)).alias("tokens"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row (n, sum_dl, avgdl) of (key, tokens); documents without tokens count too."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("sum_dl"))
    return row.withColumn("avgdl", F.when(F.col("n") > 0, F.greatest(F.lit(1.0), F.col("sum_dl") / F.col("n"))).otherwise(F.lit(1.0)))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, df, idf) of (key, tokens): one scan and one exchange, with partial counts before it.

    A row without a term for each document carries its length, so that the statistics come out of the
    same exchange; they are told apart after it, which lets Spark use it for both.
    """
    rows = docs.select(F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"), F.size("tokens").alias("dl"))
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("_s"))
    n = counts.where("_s is not null").select(F.col("df").alias("n"))
    return counts.where("_s is null").join(F.broadcast(n), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def updated(vocab: DataFrame, stats: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and statistics after more documents (key, tokens), from the old tables and the new rows only."""
    new = statistics(more)
    both = stats.select("n", "sum_dl").unionByName(new.select("n", "sum_dl")).agg(F.sum("n").alias("n"), F.sum("sum_dl").alias("sum_dl"))
    both = both.withColumn("avgdl", F.when(F.col("n") > 0, F.greatest(F.lit(1.0), F.col("sum_dl") / F.col("n"))).otherwise(F.lit(1.0)))
    fresh = more.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counts = vocab.select("term", "df").unionByName(fresh).groupBy("term").agg(F.sum("df").alias("df"))
    return counts.join(F.broadcast(both), how="cross").select("term", "df", idf(F.col("n"), F.col("df")).alias("idf")), both


def frequencies(docs: DataFrame, key: str) -> DataFrame:
    """(key, dl, term, tf) of (key, tokens), one row a key: terms are counted inside the row, without an exchange."""
    return docs.select(key, F.size("tokens").cast("long").alias("dl"), F.explode(counted(F.col("tokens"))).alias("_t")).select(key, "dl", "_t.term", "_t.tf")


def weights(docs: DataFrame, vocab: DataFrame, stats: DataFrame, key: str, bm25: Bm25 = Bm25(), own: bool = False) -> DataFrame:
    """Postings (key, term, tf, w) of (key, tokens), one row a key: terms outside the vocabulary are
    dropped before lengths are taken, and weights that are not positive after.

    own: the vocabulary holds all terms of ``docs``, so that lengths are known without an exchange.
    Terms that more than a thousandth of all rows have are joined by broadcast, so that no term's
    documents meet in one task.
    """
    rows = frequencies(docs, key)
    if own:
        return weighed(by_size(rows, vocab.select("term", "idf", "df"), "term", "df", docs.count()), stats, key, bm25)
    return weighed(rows.join(vocab.select("term", "idf"), "term").withColumn("dl", F.sum("tf").over(Window.partitionBy(key))), stats, key, bm25)


def weighed(known: DataFrame, stats: DataFrame, key: str, bm25: Bm25 = Bm25(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf, w) of counted terms (key, dl, term, tf, idf), with further columns to keep."""
    rows = known.join(F.broadcast(stats.select("avgdl")), how="cross")
    f, length = F.col("tf"), 1 - bm25.b + bm25.b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))
    w = F.col("idf") * f * (bm25.k1 + 1) / (f + bm25.k1 * length)
    return rows.select(key, "term", "tf", w.alias("w"), *keep).where("w > 0")


def sparse_vectors(postings: DataFrame, key: str) -> DataFrame:
    """(key, vector map<term, weight>) of postings; one row a document."""
    return postings.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "w")))).alias("vector"))
