"""Small cases with hand-worked results."""

from __future__ import annotations

import json
import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell import config
from tidewell.functions import text as T
from tidewell.functions.filters import FilterError, condition
from tidewell.functions.vectors import cosine
from tidewell.operators import context, dialogue, maxscore, quality, search, vocabulary
from tidewell.plans import answer, chains, spec
from tidewell.sources import collection, page_index, readers, term_index
from tidewell.streaming import ingest


def test_settings_change():
    new = config.with_changes(config.Settings(), {"bm25.k1": 2.0, "mapping": {"summary": "q"}})
    assert new.bm25.k1 == 2.0 and new.mapping.summary == "q" and config.Settings().bm25.k1 == 1.5
    with pytest.raises(ValueError):
        config.with_changes(config.Settings(), {"dialogue.cut_scale": 1})
    with pytest.raises(ValueError):
        config.with_changes(config.Settings(), {"nothing.here": 1})


def test_paths_and_merge(tmp_path):
    assert config.expand_path("a.b[1].c", 3) == {"a": {"b": [{}, {"c": 3}]}}
    assert config.deep_merge({"a": [1, {"x": 1}], "b": 2}, {"a": [5, {"y": 2}, 7]}) == {"a": [5, {"x": 1, "y": 2}, 7], "b": 2}
    pytest.importorskip("yaml")
    config.save(config.Settings(collection="c"), tmp_path / "s.yaml")
    assert config.load(tmp_path / "s.yaml").collection == "c"
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")


@given(st.lists(st.one_of(st.integers(), st.text(max_size=3))), st.lists(st.integers()))
def test_merge_keeps_the_longer_list(a, b):
    assert len(config.deep_merge(a, b)) == max(len(a), len(b))


def test_request_limits():
    with pytest.raises(ValueError):
        spec.Route(limit=501)
    with pytest.raises(ValueError):
        spec.Fusion(k=201)
    with pytest.raises(ValueError):
        spec.search_from({"routes": [{"metric": "L2"}]})
    assert spec.search_from({"routes": [{"limit": 5}], "limit": 3, "output": ["text"]}).routes[0].limit == 5


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "pk long, text string")
    tok = vocabulary.tokenised(docs, "pk", "text")
    stats, vocab = vocabulary.statistics(tok).first(), {r["term"]: r for r in vocabulary.vocabulary(tok).collect()}
    assert (stats["n"], stats["sum_dl"], round(stats["avgdl"], 9)) == (3, 4, round(4 / 3, 9))
    assert vocab["a"]["df"] == 1 and math.isclose(vocab["a"]["idf"], math.log(1 + 2.5 / 1.5))
    got = {(r["pk"], r["term"]): r["w"] for r in vocabulary.weights(tok, vocabulary.vocabulary(tok), vocabulary.statistics(tok), "pk").collect()}
    want = math.log(1 + 2.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3)))
    assert math.isclose(got[1, "a"], want) and (3, "a") not in got
    assert vocabulary.sparse_vectors(vocabulary.weights(tok, vocabulary.vocabulary(tok), vocabulary.statistics(tok), "pk"), "pk").count() == 2


def test_terms_are_counted_in_the_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],), (["x"],)], "t array<string>")
    got = [[(x["term"], x["tf"]) for x in r["c"]] for r in rows.select(T.counted(F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 3), ("c", 1)], [], [("x", 1)]]


def test_term_index(spark, tmp_path):
    path = str(tmp_path / "terms")
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "pk long, text string")
    tok = vocabulary.tokenised(docs, "pk", "text")
    assert term_index.load(spark, path) is None
    built = term_index.build(tok, path)
    plain = vocabulary.weights(tok, vocabulary.vocabulary(tok), vocabulary.statistics(tok), "pk")
    assert sorted(map(tuple, built.postings.select("pk", "term", "tf", "w").collect())) == sorted(map(tuple, plain.collect()))
    term_index.build(vocabulary.tokenised(docs.where("pk < 2"), "pk", "text"), path)
    (tmp_path / "terms" / "v2" / "vocabulary").mkdir(parents=True)  # a build that ended half-way
    assert term_index.version(spark, path) == 1 and term_index.load(spark, path).statistics.first()["n"] == 1
    a = spark.createDataFrame([("a",)], "term string")
    assert {r["term"] for r in built.blocks_of(a).collect()} >= {"a"} and built.blocks_of(a).count() <= 3


def test_block_max_search_skips_blocks(spark, tmp_path):
    """Scores as by reading everything, ties and few documents too; most blocks of frequent terms are not read."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(5, 40))) + (f" r{rng.randrange(40)}" * rng.randint(0, 3)) for _ in range(3000)]
    tok = vocabulary.tokenised(spark.createDataFrame(list(enumerate(texts)), "pk long, text string"), "pk", "text")
    index = term_index.build(tok, str(tmp_path / "terms"))
    assert index.blocks.agg({"part": "max"}).first()[0] > 10 and index.postings.count() == sum(len(set(t.split())) for t in texts)
    asked = [" ".join([*rng.sample(common, 6), f"r{k}", f"r{k + 1}"]) for k in range(10)] + ["c0", "r5", "nothing"]
    queries = vocabulary.tokenised(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), "query_id", "text")
    weights = vocabulary.weights(queries, index.vocabulary, index.statistics, "query_id").select("query_id", "term", "w")
    for allowed in (None, spark.range(0, 3000, 3).withColumnRenamed("id", "pk")):
        trace: dict = {}
        got = search.ranked(maxscore.top(weights, index, 10, allowed, trace), 10)
        postings = index.postings if allowed is None else index.postings.join(allowed, "pk", "left_semi")
        want = search.ranked(search.sparse_scores(weights, postings), 10)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["pk"], round(r["score"], 6)) for r in df.collect())
        assert rows(got) == rows(want) and len(rows(got)) > 100
        assert trace["essential"] < trace["all"] and trace["rest"] < trace["all"]


def test_frequent_terms_are_joined_alike(spark):
    docs = spark.range(3000).select(F.col("id").alias("pk"), F.array(F.lit("the"), F.concat(F.lit("w"), F.col("id") % 40)).alias("tokens"))
    vocab, stats = vocabulary.vocabulary(docs), vocabulary.statistics(docs)
    own = vocabulary.weights(docs, vocab, stats, "pk", own=True)
    assert own.count() == 6000 and own.exceptAll(vocabulary.weights(docs, vocab, stats, "pk")).count() == 0


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2)], "query_id long, pk long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 3.0, 1), (1, 12, 1.0, 2)], "query_id long, pk long, score double, rank int")
    rrf = [(r["pk"], round(r["score"], 9)) for r in search.fused([a, b], spec.Fusion("rrf", 60), ["COSINE", "IP"], 5).orderBy("rank").collect()]
    assert rrf == [(11, round(1 / 62 + 1 / 61, 9)), (10, round(1 / 61, 9)), (12, round(1 / 62, 9))]
    raw = {r["pk"]: r["score"] for r in search.fused([a, b], spec.Fusion("weighted", weights=(0.8, 0.2), normalise=False), ["COSINE", "IP"], 5).collect()}
    assert math.isclose(raw[11], 0.8 * 0.5 + 0.2 * 3) and math.isclose(raw[12], 0.2)


def test_pack(spark):
    docs = spark.createDataFrame([("q", 1, "x" * 40), ("q", 2, "y" * 40), ("q", 3, "z" * 40), ("r", 1, "w" * 400)], "query_id string, rank int, text string")
    got = {(r["query_id"], r["rank"]): r["packed"] for r in context.pack(docs, F.lit(34)).collect()}
    assert got["q", 1] == "x" * 40 and got["q", 2] == "y" * 40 and got["q", 3] == "z" * 8 + T.CUT_MARK and got["r", 1] == "w" * 120 + T.CUT_MARK
    exact = {(r["query_id"], r["rank"]) for r in context.pack(docs.where("query_id = 'q'"), F.lit(28)).collect()}
    assert exact == {("q", 1), ("q", 2)}


def test_text_helpers(spark):
    row = spark.range(1).select(
        T.strip_thinking(F.lit("<think>a\nb</think>\n  x <think>c</think> y ")).alias("think"),
        T.fenced_json(F.lit('so {"a": {"b": 1}} end')).alias("braces"),
        T.fenced_json(F.lit('so {"a":{"b":{"c":1}},"d":2} end {')).alias("deep"),
        T.fenced_json(F.lit("{ open")).alias("open"),
        T.fenced_json(F.lit(" none ")).alias("plain"),
        T.first_object(F.lit("x {a} {b}")).alias("first"),
        T.label_names(F.array(F.lit(0), F.lit(9)), T.DEPARTMENTS, T.UNKNOWN_DEPARTMENT).alias("names"),
        T.last_numbered(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("last"),
        T.cjk_grams(F.lit("中文字 ab")).alias("grams"),
        answer.clarified(F.array(F.lit("q1"), F.lit("q2")), F.array(F.lit("a"), F.lit(" "))).alias("clar"),
        answer.final_text(F.lit("fail"), F.lit("")).alias("final"),
    ).first()
    assert row["deep"] == '{"a":{"b":{"c":1}},"d":2}' and row["open"] == ""
    assert row["think"] == "x y" and row["braces"] == '{"a": {"b": 1}}' and row["plain"] == "none" and row["first"] == "{a}"
    assert row["names"] == ["内科系统", "未知科室"] and row["last"] == "## 文档1：\nc\n## 文档2：\nb\n" and row["grams"] == ["中文", "文字"]
    assert row["clar"] == "q1：a" and row["final"] == T.EMPTY_MARK + T.DOUBT_MARK


def test_filters(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c[", 3)], "id string, n int")
    ids = lambda f: sorted(r["id"] for r in rows.where(condition(f)).collect())
    assert ids('id in ["a","b"]') == ["a", "b"] and ids('id == "c["') == ["c["] and ids("") == ["a", "b", "c["] and ids("not (n < 2) && n != 3") == ["b"]
    assert ids("2 <= n and id NOT IN ('b')") == ["c["] and ids(r"id like 'c%' || n = -1") == ["c["] and ids("id is not null and !(n>=2)") == ["a"] and ids("n in []") == []
    more = spark.createDataFrame([(["x", 'q"'], (1,), True), (None, None, None)], "tags array<string>, meta struct<k:int>, ok boolean")
    count = lambda f: more.where(condition(f)).count()
    assert count(r'array_contains(tags, "q\"") and meta.k == 1 and ok == true') == 1 and count("tags is null") == 1


@pytest.mark.parametrize("text", ["id === == 1", "java_method('java.lang.System', 'getProperty', 'user.name') == 'root'", "exists (select 1)", "id in (select id)", "id == reverse('a')", "n + 1 == 2", "id", "n == 1 n", "n == 1; n", "not", "id in ['a'", "id like n", "array_contains(tags, upper('x'))", "n == current_user", "(n == 1"])
def test_filters_of_no_known_form_are_refused(text):
    with pytest.raises(FilterError):
        condition(text)


def test_dialogue(spark):
    rows = spark.createDataFrame([("s", i, "user" if i % 2 else "assistant", f"m{i}" * 20) for i in range(1, 10)], "session_id string, seq long, role string, content string")
    folded = [r["seq"] for r in dialogue.compression(rows, max_tokens=50).where("folded").orderBy("seq").collect()]
    assert folded == [1, 2, 3, 4]
    assert dialogue.turns(rows).where("answer is null").count() == 1
    one = spark.range(1).select(dialogue.rolled(F.array(*[F.lit(str(i)) for i in range(8)])).alias("r")).first()["r"]
    assert one == ["0\n1\n2\n3", "4", "5", "6", "7"]
    users = spark.createDataFrame([("12345678901",)], "phone string")
    wanted = spark.createDataFrame([("12345678901", "secret1", "user"), ("12345678902", "secret1", "user"), ("12345678903", "x", "user")], "phone string, password string, role string")
    assert [r["phone"] for r in dialogue.new_users(users, wanted).collect()] == ["12345678902"]


def test_annotations(spark):
    raw = spark.createDataFrame([('{"departments": [1], "categories": [0, 7]}',), ('{"departments": [], "categories": [1]}',), ('{"departments": [1,2,3,4], "categories": [1]}',), ("junk",), ('{"departments": [6], "categories": [1]}',)], "reply string")
    assert [r["ok"] for r in quality.parsed_annotations(raw).collect()] == [True, False, False, False, False]


def test_collection(spark, tmp_path):
    store = collection.Collection(spark, str(tmp_path / "c"))
    rec = lambda rows: spark.createDataFrame(rows, "question string, answer string, tag string")
    assert store.ingest(rec([("q1", "a1", "t"), ("q1", "a2", "t"), (None, "a3", None)])) == 2
    assert store.ingest(rec([("q1", "new", "t"), ("q2", "b", "t")]), drop_old=False) == 3
    assert {r["document"] for r in store.read().collect()} == {"new", "b", "a3"}
    assert store.create(rec([("x", "y", "z")]), drop_old=False) is False
    store.delete(store.read(["pk", "summary"]).where("summary = 'q2'"))
    assert store.read().count() == 2 and store.read(["extras"]).where("extras['tag'] = 't'").count() == 1


def test_collection_touches_only_its_buckets(spark, tmp_path):
    store = collection.Collection(spark, str(tmp_path / "c"), buckets=8)
    rows = spark.range(200).select(F.col("id").cast("string").alias("pk"), F.lit(0).alias("v"))
    store.create(rows)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "c" / "data").rglob("*.parquet")}
    before = files()
    store.insert(spark.createDataFrame([("new", 1, "x")], "pk string, v int, more string"))
    assert before.items() <= files().items() and store.read().count() == 201 and store.read().where("more is not null").count() == 1
    store.upsert(spark.createDataFrame([("7", 5, None)], "pk string, v int, more string"))
    store.delete(spark.createDataFrame([("8",)], "pk string"))
    assert before.items() <= files().items()
    got = {r["pk"]: r["v"] for r in store.read().collect()}
    assert len(got) == 200 and got["7"] == 5 and "8" not in got and got["9"] == 0
    named = json.loads((tmp_path / "c" / "versions" / "v3").read_text())["buckets"]
    first = json.loads((tmp_path / "c" / "versions" / "v0").read_text())["buckets"]
    assert sum(named[b][0] == first[b][0] for b in first) >= 5
    assert store.read().count() == 200
    with pytest.raises(Exception, match="v3|exist"):
        store._commit({"version": 2}, rows.schema, {})


def test_collection_merges_layers_and_splits_buckets(spark, tmp_path):
    """Inserts, upserts and deletes in any order against a plain list; layers stay few, buckets grow, and no
    write is larger than what it adds but for merging."""
    rng = random.Random(11)
    layout = collection.Layout(buckets=2, bucket_rows=60, layers=3, share=0.5)
    store, plain = collection.Collection(spark, str(tmp_path / "c"), layout=layout), []
    rows = lambda keys, v: spark.createDataFrame([(str(k), v) for k in keys], "pk string, v int")
    store.create(rows(range(100), 0))
    plain += [(str(k), 0) for k in range(100)]
    for step in range(1, 13):
        keys = rng.sample(range(400), 12)
        kind = rng.choice(["insert", "upsert", "upsert", "delete"])
        if kind == "delete":
            store.delete(rows(keys, 0))
        else:
            getattr(store, kind)(rows(keys, step))
        plain = [x for x in plain if kind == "insert" or int(x[0]) not in keys] + ([] if kind == "delete" else [(str(k), step) for k in keys])
        if step % 4 == 0:
            assert sorted(map(tuple, store.read().collect())) == sorted(plain), step
    manifest = store._manifest()
    assert manifest["count"] > 2 and max(map(len, manifest["buckets"].values())) <= layout.layers + 1
    assert store.compact(whole=True) and sorted(map(tuple, store.read().collect())) == sorted(plain)
    assert all(len(x) == 1 for x in store._manifest()["buckets"].values()) and not store.compact(whole=True)
    assert store.vacuum() > 0 and sorted(map(tuple, store.read().collect())) == sorted(plain)


def test_an_upsert_writes_its_own_size(spark, tmp_path):
    store = collection.Collection(spark, str(tmp_path / "c"))
    store.create(spark.range(200_000).select(F.col("id").cast("string").alias("pk"), F.lit("old").alias("v")))
    written = lambda: sum(p.stat().st_size for p in (tmp_path / "c" / "data").rglob("*.parquet"))
    before = written()
    store.upsert(spark.range(0, 200_000, 1000).select(F.col("id").cast("string").alias("pk"), F.lit("new").alias("v")))
    assert written() - before < before / 10
    assert store.read().groupBy("v").count().orderBy("v").collect() == [("new", 200), ("old", 199_800)]


def test_ingest_in_batches(spark, tmp_path):
    store, told = collection.Collection(spark, str(tmp_path / "c")), []
    rec = spark.range(25).select(F.concat(F.lit("q"), "id").alias("question"), F.lit("a").alias("answer"))
    assert store.ingest(rec, batch=10, progress=lambda *x: told.append(x)) == 25
    assert told == [(10, 25), (20, 25), (25, 25)]


def test_readers(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, v int").write.json(str(tmp_path / "x.json"))
    assert readers.read_records(spark, str(tmp_path / "x.json"), "k string, v int").count() == 1
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.csv")
    (tmp_path / "stop.txt").write_text("a b\n a\n")
    assert sorted(r["word"] for r in readers.stop_words(spark, [str(tmp_path / "stop.txt")]).collect()) == ["a", "b"]
    assert spark.range(1).select(F.size(readers.documents_of(F.lit("junk"))).alias("n")).first()["n"] == 0


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame([(f"q{i}", f"a{i}"), ("same", f"s{i}")], "question string, answer string").coalesce(1).write.mode("append").json(str(source))
    store = collection.Collection(spark, str(tmp_path / "c"))
    stream = spark.readStream.schema("question string, answer string").option("maxFilesPerTrigger", 1).json(str(source))
    ingest.ingest_stream(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert store.read().count() == 4


def test_session_state(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("s", 1, "user", "abc"), ("s", 2, "assistant", "de"), ("t", 1, "user", "")]
    spark.createDataFrame(rows, "session_id string, seq long, role string, content string").write.json(str(source))
    stream = spark.readStream.schema("session_id string, seq long, role string, content string").json(str(source))
    q = ingest.session_state(stream).writeStream.outputMode("update").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r[0], r[1], r[2], r[3]) for r in spark.table("sess").collect()} == {("s", 2, 5, "assistant"), ("t", 1, 0, "user")}


def test_answers(spark):
    q = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 1, "because")], "query_id long, rank int, text string")
    assert answer.answers(q, hits).first()["answer"] == "Answer:"
    turn = spark.createDataFrame([("s", "q" * 30, "a", "r", ["d"])], "session_id string, question string, answer string, query string, documents array<string>")
    rows = answer.saved_turn(turn).orderBy("role").collect()
    assert rows[0]["extra"] == '{"rewritten_query":"r","documents":["d"]}' and rows[1]["title"] == "q" * 20
    keep = spark.createDataFrame([(1, [2, 1])], "query_id long, keep array<int>")
    assert answer.retained(hits, keep).count() == 1
    plan = spark.createDataFrame([(1, "q", False, ["x"], " ")], "query_id long, question string, need_split boolean, sub_query array<string>, rewrite_query string")
    assert [r["query"] for r in answer.sub_queries(plan).collect()] == ["q"]
    asks = spark.createDataFrame([(True, 0, None), (True, 5, None), (False, 0, "b")], "need_ask boolean, asked int, background string")
    assert [r["step"] for r in answer.clarification(asks).collect()] == ["ask", "extract", "update"]


def test_cosine_of_zero(spark):
    assert spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()["c"] == 0.0


def test_login_and_user_info(spark):
    users = spark.createDataFrame([("12345678901", "secret1", "doctor")], "phone string, password string, role string").select("phone", F.sha2("password", 256).alias("password_hash"), "role")
    tries = spark.createDataFrame([("12345678901", "secret1"), ("12345678901", "wrong"), ("0", "secret1")], "phone string, password string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tokens = spark.createDataFrame(dialogue.logins(users, tries, now).collect())
    assert tokens.count() == 1 and tokens.first()["token"] != dialogue.logins(users, tries, now).first()["token"]
    assert dialogue.user_info(tokens, users, F.lit("2024-01-30").cast("timestamp")).first()["role"] == "doctor"
    assert dialogue.user_info(tokens, users, F.lit("2024-02-05").cast("timestamp")).count() == 0


def test_health(spark):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "service string, ok boolean")
    assert quality.all_healthy(rows).first().asDict() == {"ok": False, "failing": ["b", "c"]}
    assert quality.all_healthy(rows.limit(0)).first()["ok"] is True


def test_annotation_run_with_sinks(spark, tmp_path):
    source = str(tmp_path / "in.json")
    spark.createDataFrame([("1", "q", "a"), ("2", "", "a"), ("3", "bad", "a")], "id string, question string, answer string").write.json(source)
    calls = lambda prompt, attempt: F.when(F.contains(prompt, F.lit("bad")), "junk").otherwise('{"departments": [1], "categories": [2]}')
    assert quality.run_annotation(spark, source, str(tmp_path / "out.json"), calls) == {"processed": 2, "succeeded": 1, "failed": 1}
    row = spark.read.json(str(tmp_path / "out.json")).first()
    assert (row["id"], row["attempt"], row["department_names"]) == ("1", 1, ["外科系统"])


def test_rewriting_run(spark, tmp_path):
    source = str(tmp_path / "in.json")
    spark.createDataFrame([(str(i), f"q{i}", "a", "t") for i in range(9)], "id string, question string, answer string, text string").write.json(source)
    model = lambda prompt: F.when(F.contains(prompt, F.lit("q3")), "no").otherwise('<think>x</think>{"question": "Q", "answer": "A"}')
    assert quality.run_rewriting(spark, source, str(tmp_path / "out.json"), "id", 9, 1, model) == 8
    assert "text" not in spark.read.json(str(tmp_path / "out.json")).columns


def test_search_graph_modes(spark):
    asked = spark.createDataFrame([(1, "why")], "query_id long, query string")
    found = spark.createDataFrame([(1, 1, "because")], "query_id long, rank int, passage string")
    search_ = lambda q: q.join(found, "query_id").select("query_id", "rank", "passage")
    never = lambda prompt, text, attempt: F.lit("<think>yes</think>no")
    slow = chains.search_graph(asked, search_, None, None, never, attempts=2).first()
    assert slow["route"] == "fail" and slow["final"] == slow["answer"] + T.DOUBT_MARK
    fast = chains.search_graph(asked, search_, None, None, never, mode="fast").first()
    assert fast["final"] == fast["answer"] != slow["answer"]
    third = chains.search_graph(asked, search_, None, None, lambda prompt, text, attempt: F.lit("Yes" if attempt == 1 else "no"), attempts=2).first()
    assert third["route"] == "pass" and third["answer"] not in (fast["answer"], slow["answer"])
    with pytest.raises(ValueError):
        chains.search_graph(asked, search_, None, None, never, mode="normal")


def test_envelope(spark):
    rows = spark.createDataFrame([("a", True, [1]), (None, None, [2])], "answer string, ok boolean, documents array<int>")
    got = [(r["answer"], r["documents"]) for r in chains.with_envelope(rows).collect()]
    assert got == [("a", [1]), (chains.SORRY, [])]


def test_templates():
    T.register_template("own", "{a}!")
    assert "own" in T.template_names() and T.template("own") == "{a}!"


def test_one_route_and_registered_search(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y")], "pk long, summary_dense array<double>, text string")
    asked = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, q array<double>")
    one = spec.api_search(1, hybrid=False)
    got = search.hybrid(asked, rows.withColumns({c: F.lit("") for c in one.output if c != "text"}), rows, rows, one).collect()
    assert [(r["pk"], r["rank"]) for r in got] == [(1, 1)]
    pages = readers.from_rows(spark, [{"page_id": 1, "url": "u", "html": "<p>red fox</p>"}], "page_id long, url string, html string")
    readers.register_search("stored", page_index.searcher(page_index.build(pages, str(tmp_path / "pages"))))
    found = readers.SEARCHES["stored"](spark.createDataFrame([(1, "fox", 3)], "query_id long, query string, cnt int")).first()
    assert (found["rank"], found["passage"]) == (1, "red fox")
