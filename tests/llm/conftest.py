"""Fixtures of the corpus operators: a folder of small awkward tables."""

from __future__ import annotations

import random

import pytest


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "do", "ki", "lu", "me", "sor", "tan", "vel"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty, blank, repeated, near and very long texts, and columns whose names operators might use."""
    rng = random.Random(3)
    base = prose(rng, 200)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (20, 90, 150)]
    texts = [None, "", " \t\n", "one", "one two", "One TWO", base, base, base.upper(), *near, prose(rng, 30_000), "ünï çödé ▁ 漢字 \x00 x", *(prose(rng, 60) for _ in range(30))]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]), i * 0.5, "s", -1, "x") for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, None, 0.0, "", 0, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, keep_id string, n int, `_e` string")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
