"""Connected components of a table of links, by passing on the smallest id and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, saved


#: Nodes up to which a round's labels are sent to all tasks; more are joined by a shuffle.
MOST_BROADCAST = 1 << 16


def components(links: DataFrame, rounds: int = 60, most: int = MOST_BROADCAST) -> DataFrame:
    """(node, comp): every node of ``links`` (a, b) with the smallest node it can reach.

    Each round gives a node the smallest label around it and then that label's own label, so that
    chains shorten by a power of two; the labels are a table in the shared folder. A round of up to
    ``most`` nodes shuffles once, labels only, and as many tasks as there are cores end it.
    """
    tables = [both := saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())]
    tables.append(labels := saved(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp"))))
    nodes = labels.count()
    if not nodes:
        return labels
    for _ in range(rounds):

        def known(node: str, comp: str, labels: DataFrame = labels) -> DataFrame:
            named = labels.select(F.col("node").alias(node), F.col("comp").alias(comp))
            return F.broadcast(named) if nodes <= most else named

        own = labels.select(F.col("node").alias("a"), "comp", F.col("comp").alias("was"))
        seen = both.join(known("b", "comp"), "b").select("a", "comp", F.lit(None).alias("was"))
        least = seen.unionByName(own).groupBy("a").agg(F.min("comp").alias("c"), F.max("was").alias("was"))
        comp = F.coalesce("further", "c")
        moves = Observation()
        new = least.join(known("c", "further"), "c", "left").select(F.col("a").alias("node"), comp.alias("comp"), (comp != F.col("was")).alias("moved"))
        new = new.observe(moves, F.count_if("moved").alias("moved"))
        new = saved(new.coalesce(links.sparkSession.sparkContext.defaultParallelism) if nodes <= most else new)
        moved = moves.get["moved"]
        tables.append(new)
        labels = new.select("node", "comp")
        if not moved:
            discard(*tables[:-1])
            return labels
    raise RuntimeError("components did not settle")
