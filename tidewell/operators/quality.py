"""Annotation checks and evaluation of answers and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import read_records

ANNOTATION = "departments array<int>, categories array<int>, reasoning string"
PROMPT = "Question: {question}\nAnswer: {answer}\nLabels:"


def valid_ids(ids: Column, most_id: int) -> Column:
    """One to three ids, each from 0 to ``most_id``."""
    return F.coalesce(F.size(ids).between(1, 3) & F.forall(ids, lambda x: F.coalesce(x.between(0, most_id), F.lit(False))), F.lit(False))


def parsed_annotations(raw: DataFrame, reply: str = "reply") -> DataFrame:
    """Model replies as annotations with names and ``ok``."""
    rows = raw.withColumn("_a", F.from_json(T.fenced_json(F.col(reply)), ANNOTATION))
    rows = rows.select("*", "_a.departments", "_a.categories", "_a.reasoning").drop("_a")
    ok = valid_ids(F.col("departments"), len(T.DEPARTMENTS) - 1) & valid_ids(F.col("categories"), len(T.CATEGORIES) - 1)
    return rows.withColumns({"ok": ok, "department_names": T.label_names(F.col("departments"), T.DEPARTMENTS, T.UNKNOWN_DEPARTMENT), "category_names": T.label_names(F.col("categories"), T.CATEGORIES, T.UNKNOWN_CATEGORY)})


def annotated(records: DataFrame, model: Callable[[Column, int], Column], retries: int = 3, fallback: str | None = None) -> DataFrame:
    """Records (id, question, answer, ...) with a model's annotation: ``ok``, ``attempt`` (from 1; null
    where none was good), departments, categories, reasoning and their names.

    Records without a question or answer are left out. A reply that cannot be read or has ids outside the
    tables is asked for again, ``retries`` times in all; the rounds are unrolled, so a record's later
    prompts are made only where the earlier replies failed. A null id becomes that of ``fallback``.
    """
    rows = answerable(records)
    if fallback:
        rows = rows.withColumn("id", F.coalesce("id", F.col(fallback)))
    prompt = T.fill(PROMPT, question=F.col("question"), answer=F.col("answer"))
    good: Column | None = None
    replies = [model(prompt, attempt) for attempt in range(1, retries + 1)]
    for attempt in range(retries, 0, -1):
        one = F.from_json(T.fenced_json(replies[attempt - 1]), ANNOTATION)
        ok = valid_ids(one["departments"], len(T.DEPARTMENTS) - 1) & valid_ids(one["categories"], len(T.CATEGORIES) - 1)
        mine = F.struct(F.lit(attempt).alias("attempt"), one.alias("a"))
        good = F.when(ok, mine) if good is None else F.when(ok, mine).otherwise(good)
    out = rows.withColumn("_g", good).select("*", F.col("_g").isNotNull().alias("ok"), F.col("_g.attempt").alias("attempt"), "_g.a.departments", "_g.a.categories", "_g.a.reasoning").drop("_g", fallback or "_g")
    return out.withColumns({"department_names": T.label_names(F.col("departments"), T.DEPARTMENTS, T.UNKNOWN_DEPARTMENT), "category_names": T.label_names(F.col("categories"), T.CATEGORIES, T.UNKNOWN_CATEGORY)})


def run_annotation(spark: SparkSession, source: str, target: str, model: Callable[[Column, int], Column], retries: int = 3) -> dict[str, int]:
    """Reads records, annotates them and writes the good ones as JSON lines; the counters."""
    done = annotated(read_records(spark, source), model, retries)
    done.where("ok").drop("ok").write.mode("overwrite").json(target)
    return counters(done).first().asDict()


def evaluated(rows: DataFrame, key: str, n: int, seed: int, answer: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], Column]) -> DataFrame:
    """A seeded sample of n rows, answered and with its ``verdict``."""
    done = answer(sampled(rows, key, n, seed))
    return done.withColumn("verdict", judge(done))


def run_rewriting(spark: SparkSession, source: str, target: str, key: str, n: int, seed: int, model: Callable[[Column], Column]) -> int:
    """Samples records, has their questions and answers rewritten and writes those with both as JSON
    lines; how many."""
    rows = sampled(read_records(spark, source), key, n, seed)
    prompt = T.fill(PROMPT, question=T.to_text(F.col("question")), answer=T.to_text(F.col("answer")))
    rewritten_pairs(rows.withColumn("reply", model(prompt))).write.mode("overwrite").json(target)
    return spark.read.json(target).count()


def all_healthy(checks: DataFrame) -> DataFrame:
    """One row: whether every service (service, ok) is well, and which are not."""
    return checks.agg(F.coalesce(F.every(F.coalesce("ok", F.lit(False))), F.lit(True)).alias("ok"), F.array_sort(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.col("service")))).alias("failing"))


def answerable(records: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Records with both a question and an answer."""
    return records.where((F.coalesce(F.col(question), F.lit("")) != "") & (F.coalesce(F.col(answer), F.lit("")) != ""))


def counters(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count(F.lit(1)).alias("processed"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of key and seed: the same rows each time."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), key).limit(n)


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, reciprocal_rank) at k of hits (query_id, pk, rank) against (query_id, pk)."""
    top = hits.where(F.col("rank") <= k).join(relevant.withColumn("_rel", F.lit(1)), ["query_id", "pk"], "left").where("_rel = 1")
    return _at_k(top, relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("_want")), k)


def label_metrics(hits: DataFrame, asked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``retrieval_metrics`` where the rows (pk, label) of a query's label (query_id, label) are the relevant
    ones: they are counted by label, and no pair of query and relevant row is made."""
    sizes = labels.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    wanted = asked.join(sizes, "label").groupBy("query_id").agg(F.sum("_n").alias("_want"))
    top = hits.where(F.col("rank") <= k).join(labels, "pk").join(asked, ["query_id", "label"], "left_semi")
    return _at_k(top, wanted, k)


def _at_k(found: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Metrics of relevant hits (query_id, rank) and numbers of relevant rows (query_id, _want)."""
    per = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_hit"), F.min("rank").alias("_first"))
    rows = wanted.join(per, "query_id", "left")
    hit = F.coalesce("_hit", F.lit(0))
    return rows.select("query_id", (hit / F.col("_want")).alias("recall"), (hit / F.lit(k)).alias("precision"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"))


def answer_metrics(rows: DataFrame) -> DataFrame:
    """Offline stand-ins for judged metrics over (user_input, retrieved_contexts, response, reference):
    shares of distinct tokens that one text has in another."""
    words = lambda c: F.array_distinct(T.tokens(T.to_text(c)))
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_q": words(F.col("user_input")), "_a": words(F.col("response")), "_r": words(F.col("reference")), "_c": words(F.array_join("retrieved_contexts", " "))})
    return rows.select("user_input", share(F.col("_q"), F.col("_a")).alias("answer_relevancy"), share(F.col("_a"), F.col("_c")).alias("faithfulness"), share(F.col("_r"), F.col("_c")).alias("context_recall"), share(F.col("_c"), F.col("_r")).alias("context_precision"))


def means(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c, kind in metrics.dtypes if kind == "double"])


def annotation_results(annotated: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Annotations first, then the original's columns that they do not have."""
    more = [c for c in original.columns if c == key or c not in annotated.columns]
    return annotated.join(original.select(*more), key)


def rewritten_pairs(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Records with ``new_question`` and ``new_answer`` from model replies; those without both are dropped, and ``text`` with them."""
    body = T.first_object(F.regexp_replace(F.col(reply), r"(?s)<think>.*?</think>", ""))
    parsed = F.from_json(body, "question string, answer string")
    out = rows.withColumn("_p", parsed).withColumns({"new_question": F.coalesce("_p.question", F.lit("")), "new_answer": F.coalesce("_p.answer", F.lit(""))})
    return answerable(out, "new_question", "new_answer").drop("_p", reply, "text")
