"""A training-data pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and gives documents with the columns of ``documents``; the
last one adds the pieces of the text. Each is written as Parquet in the shared folder and read again
before the next.

Every stage takes null and empty texts, very long texts, repeated rows, null ids, empty tables and more
columns than those of ``documents``; columns beyond those pass through. No name but ``_tw_*`` and, for
the last stage, its own five results is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import mixing, pieces
from tidewell.llm.common import saved, text_of
from tidewell.llm.exact_dedup import exact_dedup
from tidewell.llm.jaccard_join import one_of_each
from tidewell.llm.queries import fold_of, table
from tidewell.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity

#: Share of all tokens that mixing keeps in expectation, and how far it flattens the categories.
KEEP, ALPHA = 0.9, 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts score as a text without n-grams does; equal texts go or stay together; without
    labelled rows every score is 0 and all stay.
    """
    model = train_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold_of("doc_id", 4) != 2)
    return score_toxicity(docs, model, into="_tw_score").where(F.col("_tw_score") < THRESHOLD).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null is the empty text and below all ids.

    Of rows that repeat an id and a text one stays.
    """
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles the one with the smallest id.

    Documents without words are linked with none and stay, as do rows with a null id; an id with several
    texts is linked by any of them, and all its rows go or stay.
    """
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the flattened shares of source, language and topic.

    Nulls are a category of their own; texts without tokens take their cell's probability; all rows of
    an id go or stay.
    """
    slim = docs.select("doc_id", "source", "lang", mixing.tokens_of(text_of(docs, "text")).alias("_tw_n"))
    slim = mixing.with_topics(slim, table(spark, sf_dir, "embeddings"))
    return mixing.keep_sampled(docs, mixing.mix(slim, tokens="_tw_n", alpha=ALPHA, keep=KEEP))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of the best segmentation, the scores and ids of the four best, and
    whether the best one's ids, decoded, are the text.

    All rows stay; null and empty texts have no pieces and the score 0, and null decodes to the empty
    text. Columns of ``docs`` that are named path_ids, round_trip, piece_ids, n_pieces or path_scores are replaced.
    """
    text = text_of(docs, "text")
    coded = docs.withColumn("_tw_coded", pieces.coder(spark, most=4)(text))
    own = {
        "path_ids": F.col("_tw_coded.paths"),
        "round_trip": F.col("_tw_coded.decoded") == text,
        "piece_ids": F.col("_tw_coded.ids"),
        "n_pieces": F.size("_tw_coded.ids").cast("long"),
        "path_scores": F.col("_tw_coded.scores"),
    }
    return coded.select(*[c for c in docs.columns if c not in own], *[value.alias(name) for name, value in own.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Training and set similarity are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
