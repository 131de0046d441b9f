import pytest
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import answering, evaluation, retrieval


def test_fusion(spark):
    legs = [("q", "bm25", "x", 1), ("q", "bm25", "both", 2), ("q", "knn", "y", 1), ("q", "knn", "both", 2), ("r", "bm25", "a", 1), ("r", "bm25", "b", 2), ("r", "knn", "b", 1), ("r", "knn", "a", 2)]
    df = spark.createDataFrame(legs, "query_id string, leg string, id string, rank int")
    got = retrieval.rrf(df, "id").orderBy("query_id", "rank").collect()
    assert got[0]["id"] == "both" and got[0]["legs"] == {"bm25": 2, "knn": 2}
    r = [x for x in got if x["query_id"] == "r"]
    assert r[0]["fused"] == r[1]["fused"] and [x["id"] for x in r] == ["a", "b"]
    assert retrieval.rrf(df.orderBy(F.rand(3)), "id").drop("legs").exceptAll(retrieval.rrf(df, "id").drop("legs")).count() == 0


def test_near_duplicates(spark):
    a = "연차 유급휴가의 부여 기준과 사용 절차를 정한다 " * 3
    hits = spark.createDataFrame([("q", 1, "a", a), ("q", 2, "b", a + " 조금 더"), ("q", 3, "c", "전혀 다른 문서의 내용이다"), ("q", 4, "d", ""), ("q", 5, "e", None), ("p", 1, "f", a)], "query_id string, rank int, id string, body string")
    got = {r["id"]: r["kept"] for r in retrieval.suppress_near(hits, "id", "body").collect()}
    assert got == {"a": True, "b": False, "c": True, "d": True, "e": True, "f": True}
    kept = retrieval.suppress_near(hits, "id", "body").where("kept").drop("kept")
    assert retrieval.suppress_near(kept, "id", "body").where("not kept").count() == 0


def test_bm25_and_knn(spark):
    rows = spark.createDataFrame([("1", "pump manual", "the pump"), ("2", "valve", "the valve and the pump"), ("3", None, None)], "id string, title string, text string")
    q = spark.createDataFrame([("q", "Pump?"), ("z", "nothing"), ("n", None)], "query_id string, query string")
    got = retrieval.top(retrieval.bm25(q, rows, "id", {"title": 3.0, "text": 1.0}), "id", 5).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [("q", "1"), ("q", "2")]
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.6, 0.8]), ("3", [0.0, 0.0]), ("4", None), ("5", [1.0, 0.0])], "id string, vector array<float>")
    qv = spark.createDataFrame([("q", [1.0, 0.0]), ("bad", None)], "query_id string, vector array<float>")
    assert [(r["id"], r["cos"]) for r in retrieval.knn(qv, v, "id", 2, 2).orderBy("rank").collect()] == [("1", 1.0), ("5", 1.0)]


def test_routing_neighbours_round_robin(spark):
    docs = spark.createDataFrame([("취업규칙-260417",), ("hxr-mc88-manual-kr1",), ("other-paper",)], "doc_id string")
    q = spark.createDataFrame([("1", "취업규칙에서 휴가는?"), ("2", "HXR MC88 menu"), ("3", "휴가는 며칠?"), ("4", "")], "query_id string, query string")
    got = {(r["query_id"], r["doc_id"]) for r in retrieval.mentions(q, docs).collect()}
    assert got == {("1", "취업규칙-260417"), ("2", "hxr-mc88-manual-kr1")}
    hits = spark.createDataFrame([("q", 1, "d", 0), ("q", 2, "d", 5), ("q", 9, "d", 9)], "query_id string, rank int, doc_id string, seq int")
    chunks = spark.createDataFrame([("d", i, f"c{i}") for i in range(8)], "doc_id string, seq int, chunk_id string")
    assert [r["chunk_id"] for r in retrieval.neighbours(hits, chunks).orderBy("at").collect()] == ["c0", "c1", "c4", "c5", "c6"]
    cards = spark.createDataFrame([("q", 1, ["a", "b"]), ("q", 2, ["b", "c", "d"])], "query_id string, card_rank int, chunk_ids array<string>")
    assert [r["chunk_id"] for r in retrieval.round_robin(cards, 3).orderBy("at").collect()] == ["a", "b", "c"]
    ranked = spark.createDataFrame([("q", 1, "A", False), ("q", 2, "B", False), ("q", 3, "A", False)], "query_id string, rank int, doc_id string, multi boolean")
    assert [r["rank"] for r in retrieval.one_document(ranked).collect()] == [1, 3]


def scored(spark, pages, hit_pages, sections=None, docs=None):
    q = spark.createDataFrame([("q", "d", "A", pages, sections)], "query_id string, doc_id string, bucket string, pages array<int>, sections array<string>")
    docs = docs or ["d"] * len(hit_pages)
    c = spark.createDataFrame([(d, f"c{i}", a, b, ["s1"]) for i, (d, (a, b)) in enumerate(zip(docs, hit_pages))], "doc_id string, chunk_id string, page int, end_page int, section_ids array<string>")
    h = spark.createDataFrame([("q", i + 1, f"c{i}", d) for i, d in enumerate(docs)], "query_id string, rank int, chunk_id string, doc_id string")
    return evaluation.score(q, h, evaluation.covered(q, c)).first()


def test_metrics(spark):
    r = scored(spark, [3], [(3, 3)] * 3)
    assert (r["ndcg"], r["recall"], r["duplicate_hits"]) == (1.0, 1.0, 2)
    assert scored(spark, [3], [(3, 3), (3, 3), (9, 9), (9, 9), (9, 9)])["chunk_precision"] == pytest.approx(0.4)
    r = scored(spark, [4], [(4, 4), (3, 5)], docs=["other", "d"])
    assert (r["first_rank"], r["rr"], r["right_doc"]) == (2, 0.5, False)
    assert scored(spark, [1], [(9, 9)], sections=["s1"])["recall"] == 1.0
    assert scored(spark, [], [(1, 1)])["ndcg"] == 0.0


def test_bootstrap_is_seeded(spark):
    a, b = [0.9, 0.8, 0.7, 1.0, 0.6], [0.5, 0.4, 0.3, 0.6, 0.2]
    df = spark.createDataFrame([("m", str(i), x, y) for i, (x, y) in enumerate(zip(a, b))], "metric string, query_id string, a double, b double")
    r = evaluation.paired_bootstrap(df, 2000).first()
    assert r["diff"] == pytest.approx(0.4) and r["ci_low"] > 0 and r["significant"]


def test_causes(spark):
    q = spark.createDataFrame([(str(i), "A") for i in range(5)], "query_id string, bucket string")
    cover = spark.createDataFrame([(str(i), "c", "p1") for i in range(4)], "query_id string, chunk_id string, target string")
    hits = spark.createDataFrame([("0", "c", 2), ("1", "c", 10)], "query_id string, chunk_id string, rank int")
    gone = spark.createDataFrame([("2", "c")], "query_id string, chunk_id string")
    got = {r["query_id"]: r["cause"] for r in evaluation.causes(q, hits, cover, gone).collect()}
    assert got == {"0": "success", "1": "rank", "2": "dedupe", "3": "candidate", "4": "chunking"}


def test_quotes_and_budgets(spark):
    body = "포상의 종류는 다음과 같다\n1. 표창\n2. 포상금\n"
    cases = {"1. 표창": True, "표창": False, "①": False, "포상의 종류는": True, "포상의\u00a0종류는 다음과": True, "": False, None: False}
    df = spark.createDataFrame([(q, body) for q in cases], "quote string, body string")
    got = {r["quote"]: r["found"] for r in df.select("quote", answering.quote_found(F.col("quote"), F.col("body")).alias("found")).collect()}
    assert got == cases
    hits = spark.createDataFrame([("q", 1, 80), ("q", 2, 80), ("q", 3, 10), ("q", 4, 0)], "query_id string, rank int, n int")
    assert [r["rank"] for r in answering.budget_prefix(hits, F.col("n"), 100).collect()] == [1]
    assert [(r["rank"], r["used"]) for r in answering.budget_skip(hits, F.col("n"), 100).orderBy("rank").collect()] == [(1, 80), (3, 90)]


def test_grounding_and_reranking(spark):
    df = spark.createDataFrame([("1", "연차 휴가 ＡＢ", ["연차휴가", "AB", "해고", ""], None), ("2", None, ["x"], [])], "chunk_id string, body string, keywords array<string>, entities array<string>")
    got = {r["chunk_id"]: (r["keywords"], r["entities"]) for r in answering.grounded_terms(df, "chunk_id", "body", "keywords", "entities").collect()}
    assert got == {"1": (["연차휴가", "AB"], None), "2": ([], [])}
    rows = [(f"q{q}", f"c{c}", int(c == 0), *([1.0 if c == 0 else 0.1 * c] * len(evaluation.FEATURES))) for q in range(12) for c in range(5)]
    data = spark.createDataFrame(rows, ["query_id", "chunk_id", "label", *evaluation.FEATURES])
    ranked = evaluation.rerank(data, evaluation.fit_reranker(data))
    assert {r["chunk_id"] for r in ranked.where("ltr_rank = 1").collect()} == {"c0"}
    assert evaluation.mean_reciprocal_rank(data, F.col("chunk_id").desc()).first()["mrr"] == pytest.approx(0.2)


def test_terms_and_phrases(spark):
    df = spark.createDataFrame([("연차휴가를 준다 A4 café",), ("訓練",), ("가",), (None,)], "t string")
    got = [r[0] for r in df.select(X.terms(F.col("t"))).collect()]
    assert got == [["연차", "차휴", "휴가", "가를", "준다", "a", "4", "café"], ["訓練"], ["가"], None]
    cases = [(["a", "b"], ["x", "a", "b"], 1.0), (["a", "b"], ["a", "x", "b"], 0.5), (["a", "b"], ["a", "x", "x", "x", "b"], 0.0), (["a", "b"], ["b"], 0.0), (["a"], ["a", "x", "a"], 2.0), (["a", "b"], [], 0.0)]
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _) in enumerate(cases)], "i int, q array<string>, t array<string>")
    assert [r[1] for r in df.select("i", X.phrase_frequency(F.col("q"), F.col("t"))).orderBy("i").collect()] == [c[2] for c in cases]


def test_phrases_rank_higher(spark):
    rows = spark.createDataFrame([("1", "t", "red pump of the valve"), ("2", "t", "pump red the valve of"), ("3", None, None)], "id string, title string, text string")
    q = spark.createDataFrame([("q", "the red pump")], "query_id string, query string")
    plain = {r["id"]: r["score"] for r in retrieval.bm25(q, rows, "id", {"title": 3.0, "text": 1.0}).collect()}
    beside = {r["id"]: r["score"] for r in retrieval.bm25(q, rows, "id", {"title": 3.0, "text": 1.0}, phrases={"text": 2.0}).collect()}
    assert plain["1"] == plain["2"]
    near = spark.createDataFrame([("q", "red pump")], "query_id string, query string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(near, rows, "id", {"text": 1.0}, phrases={"text": 2.0}).collect()}
    assert got["1"] > got["2"] > 0 and set(beside) == {"1", "2"}
    assert retrieval.bm25(near, rows.limit(0), "id", {"text": 1.0}, phrases={"text": 2.0}).count() == 0


def test_route_interleave_spread(spark):
    q = spark.createDataFrame([("1", False, ["x"]), ("2", False, None), ("3", True, []), ("4", False, None)], "query_id string, multi boolean, given array<string>")
    named = spark.createDataFrame([("1", "x", 2), ("1", "y", 1), ("2", "b", 1), ("2", "a", 2)], "query_id string, doc_id string, rank int")
    got = {r["query_id"]: (r["doc_ids"], r["several"], r["missing"]) for r in retrieval.route(q, named, F.col("multi"), "given").collect()}
    assert got == {"1": (["x"], False, ["y"]), "2": (["b", "a"], True, []), "3": ([], True, []), "4": ([], False, [])}
    base = spark.createDataFrame([("q", f"b{i}", i) for i in range(1, 6)], "query_id string, chunk_id string, rank int")
    extra = spark.createDataFrame([("q", "b5", 1), ("q", "e2", 2), ("q", "e3", 3)], "query_id string, chunk_id string, rank int")
    assert [r["chunk_id"] for r in retrieval.interleave(base, extra, 2, 2, 5).orderBy("place").collect()] == ["b1", "b2", "b5", "e2", "b3"]
    rows = spark.createDataFrame([("d", i) for i in range(7)] + [("e", 0)], "doc_id string, i int")
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(tuple(r) for r in retrieval.spread_sample(rows, "doc_id", "i", n, 4).collect()) == [("d", 0), ("d", 2), ("d", 4), ("d", 6), ("e", 0)]


def test_model_output(spark):
    row = spark.createDataFrame([("순서는 [3, 1, 9, 3] 입니다", '앞 {"action": "search", "n": 2} 뒤', "A. [cite:2] B [cite:1,2]\n---", "pump\nx\nno\nthe Pump runs\nend\nz")], "o string, j string, a string, t string")
    r = row.select(
        X.given_order(F.col("o"), F.lit(4)).alias("o"), X.first_object(F.col("j"), "action string, n int").alias("j"), X.sentences(F.col("a")).alias("s"),
        X.single_citation(F.col("a")).alias("one"), X.claims_cited(F.col("a")).alias("cited"), X.excerpt(F.lit("Pump?"), F.col("t"), 1).alias("x"), X.given_order(F.lit(None).cast("string"), F.lit(2)).alias("none"),
    ).first()
    assert r["o"] == [3, 1, 2, 4] and r["none"] == [1, 2] and (r["j"]["action"], r["j"]["n"]) == ("search", 2)
    assert [(x["n"], x["sentence"]) for x in r["s"]] == [(1, "A. [cite:2]"), (2, "B [cite:1,2]")] and r["cited"]
    assert r["one"] == "A. B\n--- [cite:1,2]" and r["x"] == "pump\nx\nno\nthe Pump runs\nend"
