"""URL filters: a character language-model ratio, with rules that go before it.

Two variable-order Markov models (Witten-Bell smoothing from order ``order`` down to a uniform
letter) are counted over accepted and rejected URLs. A URL's score is the mean log-likelihood
difference a character; the cut is calibrated on a fifth of the labelled URLs that the counts do
not see, at the point as many deviations from either class's mean. DataFrame functions only.

A character's row holds a 16-byte key of its URL and ``order`` + 1 characters, never the URL. The
models are joined order by order, where a key has at most as many rows as there are letters; frequent
n-grams and frequent URLs (more than a thousandth of the rows each, so at most a thousand) are
broadcast, all others are joined by a shuffle.

Null counts as the empty URL, whose host and path are empty and whose score is that of the end
sign alone. Long URLs are scored whole. Equal URLs are scored once. Without accepted or rejected
URLs every score is 0 and the verdict allow. Empty tables give empty results. Other columns pass
through and may have any name but ``_tw_*``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, saved

START, END = "\u0002", "\u0003"
#: n-gram tables up to this many rows are sent to every executor; larger ones are joined by a shuffle.
MOST_BROADCAST = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host/path). Ties: the first in code-point order."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> Column:
        own, slash, rest = rule.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)

    def pick(value: int) -> Column:
        return F.coalesce(*[F.when(fits(r[1]), F.lit(r[1 - value])) for r in ordered], F.lit(None).cast("string"))

    return pick(0), pick(1)


def _key(url: str) -> Column:
    return F.unhex(F.md5(url))


def _windows(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of a URL and its end: the ``order`` characters before it and itself, in
    ``gram`` in place of ``_tw_url``."""
    chars = urls.select(*[c for c in urls.columns if c != "_tw_url"], F.split(F.concat(F.lit(START * order), F.col("_tw_url"), F.lit(END)), "").alias("_p"))
    gram = ", ".join(f"_p[i - {order - k}]" for k in range(order + 1))
    return chars.select(*chars.columns[:-1], F.explode(F.expr(f"transform(sequence({order}, size(_p) - 1), i -> concat({gram}))")).alias("gram"))


def ratio_table(labelled: DataFrame, every: DataFrame, order: int) -> DataFrame:
    """``every`` (gram, ...) with ratio: log P(accepted) - log P(rejected) of a gram's last character
    after the others; counts come from ``labelled`` (_tw_url, accepted boolean)."""
    full = saved(_windows(labelled, order).groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")))
    by_order = F.explode(F.expr(f"transform(sequence(0, {order}), k -> substring(gram, {order} + 1 - k, k + 1))")).alias("g")
    grams = saved(full.select(by_order, "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    contexts = saved(grams.groupBy(F.expr("left(g, length(g) - 1)").alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.count_if(F.col("a") > 0).alias("da"), F.count_if(F.col("r") > 0).alias("dr")))
    asked = saved(every.select("gram", by_order).select("g").distinct())

    def chance(n: str, c: str, d: str, lower: str) -> Column:
        return F.when(F.col(c) > 0, (F.coalesce(F.col(n), F.lit(0)) + F.col(d) * F.col(lower)) / (F.col(c) + F.col(d))).otherwise(F.col(lower))

    lower: DataFrame | None = None
    for k in range(order + 1):
        level = asked.where(F.length("g") == k + 1).join(grams.where(F.length("g") == k + 1), "g", "left")
        own = contexts.where(F.length("c") == k)
        if lower is None:
            level = level.join(F.broadcast(own.drop("c")), how="left")
            level = level.withColumns({"pa": F.lit(1 / 256), "pr": F.lit(1 / 256)})
        else:
            level = level.withColumns({"c": F.expr("left(g, length(g) - 1)"), "_tail": F.expr("right(g, length(g) - 1)")}).join(own, "c", "left").join(lower, "_tail")
        level = level.select("g", chance("a", "ca", "da", "pa").alias("pa"), chance("r", "cr", "dr", "pr").alias("pr"))
        lower = saved(level).withColumnRenamed("g", "_tail")
    return every.join(lower.select(F.col("_tail").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio")), "gram")


def url_scores(urls: DataFrame, labelled: DataFrame, order: int = 4) -> tuple[DataFrame, float]:
    """((_tw_key, score, _tw_rows) of the distinct ``urls`` with their number of rows, the calibrated cut).

    urls: _tw_url; labelled: _tw_url, accepted boolean; a URL that is both accepted and rejected teaches both.
    """
    labelled = saved(labelled.dropDuplicates())
    seen, kept_back = labelled.where(F.crc32("_tw_url") % 5 != 0), labelled.where(F.crc32("_tw_url") % 5 == 0)
    both = {r["accepted"] for r in seen.select("accepted").distinct().collect()} == {True, False}
    asked = urls.select("_tw_url", F.lit(1).alias("n")).unionByName(kept_back.select("_tw_url", F.lit(0).alias("n")))
    ask = saved(asked.groupBy("_tw_url").agg(F.sum("n").alias("_tw_rows")).withColumn("_tw_key", _key("_tw_url")))
    if not both:
        return ask.select("_tw_key", F.lit(0.0).alias("score"), "_tw_rows"), 0.0
    places = _windows(ask.select("_tw_key", "_tw_url"), order)
    table = saved(ratio_table(seen, saved(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))), order))
    size = table.agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("rows")).first()
    means = join_by_size(places, table, "gram", "n", size["rows"] or 0, size["grams"] <= MOST_BROADCAST).groupBy("_tw_key").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))
    scores = saved(ask.select("_tw_key", "_tw_rows").join(means, "_tw_key"))
    stats = {r["accepted"]: r for r in kept_back.select("accepted", _key("_tw_url").alias("_tw_key")).join(scores, "_tw_key").groupBy("accepted").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("d")).collect()}
    if len(stats) < 2:
        return scores, 0.0
    a, r = stats[True], stats[False]
    spread = a["d"] + r["d"]
    return scores, (a["m"] * r["d"] + r["m"] * a["d"]) / spread if spread > 0 else (a["m"] + r["m"]) / 2


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", order: int = 4) -> DataFrame:
    """``pages`` with ``_tw_host, _tw_path, _tw_rule, _tw_verdict, _tw_score``.

    The models learn from the URLs that the rules decide; they decide the others. ``_tw_score`` is
    the score less the cut, null where a rule decides.
    """
    known = F.coalesce(pages[url].cast("string"), F.lit(""))
    rows = pages.withColumn("_tw_url", known).withColumn("_tw_host", host_of(known)).withColumn("_tw_path", path_of(known))
    rule, verdict = rule_of(F.col("_tw_host"), F.col("_tw_path"), rules)
    rows = rows.withColumn("_tw_rule", rule).withColumn("_tw_by_rule", verdict)
    ruled = rows.where(F.col("_tw_rule").isNotNull()).select("_tw_url", (F.col("_tw_by_rule") == "allow").alias("accepted"))
    open_ = rows.where(F.col("_tw_rule").isNull())
    scores, cut = url_scores(open_.select("_tw_url"), ruled, order)
    found = scores.where("_tw_rows > 0").select("_tw_key", F.col("score").alias("_tw_raw"), "_tw_rows")
    size = found.agg(F.count(F.lit(1)).alias("urls"), F.sum("_tw_rows").alias("rows")).first()
    by_model = join_by_size(open_.withColumn("_tw_key", _key("_tw_url")), found, "_tw_key", "_tw_rows", size["rows"] or 0, size["urls"] <= MOST_BROADCAST)
    margin = by_model.withColumn("_tw_score", F.col("_tw_raw") - F.lit(float(cut))).drop("_tw_key", "_tw_raw")
    judged = margin.unionByName(rows.where(F.col("_tw_rule").isNotNull()).withColumn("_tw_score", F.lit(None).cast("double")))
    out = judged.withColumn("_tw_verdict", F.coalesce("_tw_by_rule", F.when(F.col("_tw_score") >= 0, F.lit("allow")).otherwise(F.lit("block"))))
    return out.select(*pages.columns, "_tw_host", "_tw_path", "_tw_rule", "_tw_verdict", "_tw_score")
