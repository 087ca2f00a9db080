"""Message histories: pairing, compression, sessions and their owners.

Messages are rows (session_id, seq, role, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate


def turns(messages: DataFrame) -> DataFrame:
    """(session_id, seq, question, answer): each user message with the assistant message right after it."""
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = messages.withColumn("_role", F.lead("role").over(order)).withColumn("_next", F.lead("content").over(order))
    return rows.where("role = 'user'").select("session_id", "seq", F.col("content").alias("question"), F.when(F.col("_role") == "assistant", F.col("_next")).alias("answer"))


def last_of_role(messages: DataFrame, role: str = "user") -> DataFrame:
    """(session_id, content) of the last message of a role."""
    return messages.where(F.col("role") == role).groupBy("session_id").agg(F.max_by("content", "seq").alias("content"))


def transcript(messages: DataFrame) -> DataFrame:
    """(session_id, history): contents in order, one a line."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "content")))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("history"))


def tokens_per_char(messages: DataFrame, estimator: str = "quarter") -> DataFrame:
    """(session_id, per_char, mean_chars, predicted): tokens a character over the session and those of a mean message."""
    sums = messages.groupBy("session_id").agg(F.sum(estimate(F.col("content"), estimator)).alias("_t"), F.sum(F.length("content")).alias("_c"), F.count(F.lit(1)).alias("_n"))
    per = F.when(F.col("_c") > 0, F.col("_t") / F.col("_c")).otherwise(F.lit(0.0))
    return sums.select("session_id", per.alias("per_char"), (F.col("_c") / F.col("_n")).alias("mean_chars"), F.floor(per * F.col("_c") / F.col("_n")).cast("long").alias("predicted"))


def compression(messages: DataFrame, max_tokens: int = 1024, threshold: float = 0.7, cut_scale: int = 2, estimator: str = "quarter") -> DataFrame:
    """``messages`` with ``folded``: in sessions whose estimated tokens reach the share ``threshold`` of
    the limit, the oldest max(2, n // cut_scale) messages are to be summarised."""
    whole = Window.partitionBy("session_id")
    order = whole.orderBy("seq")
    rows = messages.withColumns({"_n": F.count(F.lit(1)).over(whole), "_t": F.sum(estimate(F.col("content"), estimator)).over(whole), "_r": F.row_number().over(order)})
    due = F.col("_t") >= F.lit(max_tokens * threshold)
    return rows.withColumn("folded", due & (F.col("_r") <= F.greatest(F.lit(2), F.floor(F.col("_n") / cut_scale)))).drop("_n", "_t", "_r")


def summaries(compressed: DataFrame, summarise=None) -> DataFrame:
    """(session_id, summary, kept): the folded messages as one text, and how many stay.

    summarise: a function of the joined text's column; as it is by default.
    """
    folded = F.array_sort(F.collect_list(F.when(F.col("folded"), F.struct("seq", "content"))))
    text = F.array_join(F.transform(folded, lambda x: x["content"]), "\n")
    told = F.when(F.count_if(F.col("folded")) > 0, summarise(text)).otherwise(F.lit("")) if summarise else text
    return compressed.groupBy("session_id").agg(told.alias("summary"), F.count_if(~F.col("folded")).alias("kept"))


def rolled(entries: Column, fold_at: int = 8, fold: int = 4, keep: int = 10) -> Column:
    """A list of summaries: at ``fold_at`` entries the oldest ``fold`` become one; the last ``keep`` stay."""
    merged = F.concat(F.array(F.array_join(F.slice(entries, 1, fold), "\n")), F.slice(entries, F.lit(fold + 1), F.size(entries)))
    now = F.when(F.size(entries) >= fold_at, merged).otherwise(entries)
    return F.when(F.size(now) > keep, F.slice(now, F.size(now) - keep + 1, F.lit(keep))).otherwise(now)


def sessions_after(sessions: DataFrame, touched: DataFrame) -> DataFrame:
    """Sessions (session_id, user_id, title, created_at, updated_at) after an upsert: an existing one
    keeps its first title and creation and takes the last time."""
    every = sessions.unionByName(touched)
    return every.groupBy("session_id").agg(F.min_by("user_id", "created_at").alias("user_id"), F.min_by("title", "created_at").alias("title"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def owned(messages: DataFrame, sessions: DataFrame, user: Column) -> DataFrame:
    """The messages of sessions that belong to a user."""
    return messages.join(sessions.where(F.col("user_id") == user).select("session_id"), "session_id", "left_semi")


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.where(F.col("expires_at") >= now)


def without_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame, user: Column) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without those of ``gone`` (session_id) that the user owns."""
    lost = sessions.where(F.col("user_id") == user).join(gone, "session_id", "left_semi").select("session_id")
    return sessions.join(lost, "session_id", "left_anti"), messages.join(lost, "session_id", "left_anti")


def new_users(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Registrations (phone, password, role) that may be stored: phones of 11 characters not taken yet,
    passwords of 6 or more, known roles; passwords as digests."""
    good = wanted.where((F.length("phone") == 11) & (F.length("password") >= 6) & F.col("role").isin("user", "doctor", "admin"))
    one = good.groupBy("phone").agg(F.min(F.struct("password", "role")).alias("_x")).select("phone", F.sha2("_x.password", 256).alias("password_hash"), "_x.role")
    return one.join(users.select("phone"), "phone", "left_anti")


def with_extras(saved: DataFrame) -> DataFrame:
    """Saved messages with what their ``extra`` JSON holds: rewritten_query, documents, sub_queries;
    empty where there is none or it cannot be read."""
    kind = "rewritten_query string, documents array<string>, sub_queries array<string>"
    none = F.array().cast("array<string>")
    rows = saved.withColumn("_x", F.from_json("extra", kind))
    return rows.withColumns({"rewritten_query": F.coalesce("_x.rewritten_query", F.lit("")), "documents": F.coalesce("_x.documents", none), "sub_queries": F.coalesce("_x.sub_queries", none)}).drop("_x")


def logins(users: DataFrame, attempts: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Tokens (phone, role, token, expires_at) of the attempts (phone, password) that match a stored user.

    A token is a random id, so the rows are to be written once, before anything reads them twice."""
    known = attempts.withColumn("password_hash", F.sha2("password", 256)).join(users, ["phone", "password_hash"])
    expires = (now + F.expr(f"INTERVAL {days} DAYS")).alias("expires_at")
    return known.select("phone", "role", F.uuid().alias("token"), expires)


def user_info(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """(token, phone, role) of the tokens that have not expired, by the users that they belong to."""
    return valid_tokens(tokens, now).select("token", "phone").join(users.select("phone", "role"), "phone").select("token", "phone", "role")
