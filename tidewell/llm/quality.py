"""Quality: naive Bayes support vectors over character n-gram indicators.

The indicators are scaled by class log-count ratios; a linear hinge-loss model is fitted by dual
coordinate descent and its margins are turned into probabilities by a fitted sigmoid. A word that
repeats the word before it counts as one sign of its own, so that runs of a word show in n-grams.

Null and empty texts get the score of a document without n-grams; very long texts are scored whole;
labels that are null or not 0/1 and rows with a null id teach nothing; repeated labels of one id
count once (the larger). Without labelled rows the score is 0.0; with one class only it is that class.
Repeated rows and equal texts get equal scores; no order or tie enters a score. An empty table gives an
empty result. Other columns are not read and pass through, whatever their names; one named as ``into``
is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_linear import NgramModel, NgramSpec, fit, hinge_dual, labelled_sample, text_of

SPEC = NgramSpec(orders=(1, 2, 3), bits=20, fold=False, mark_repeats=True, features=1 << 13, least_docs=5, sample=16_000)
THRESHOLD = 0.3


def train_quality(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, label: str = "quality", spec: NgramSpec = SPEC) -> NgramModel:
    """Fits on at most ``spec.sample`` labelled rows; ``eligible`` is a condition on ``labels``."""
    return fit(labelled_sample(docs, labels, label, F.lit(True) if eligible is None else eligible, spec), spec, hinge_dual(c=0.1))


def score_quality(docs: DataFrame, model: NgramModel, text: str = "text", into: str = "_tw_score") -> DataFrame:
    """``docs`` with the probability that the whole text is of good quality in the column ``into``."""
    return docs.withColumn(into, model.scorer(docs)(text_of(docs, text)))
