from pyspark.sql import functions as F

from docmill.sources import index_store as S
from docmill.sources.tables import materialize
from docmill.streaming import inbox


def test_replace_update_and_stale(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.createDataFrame([("a1", "a", "x"), ("a2", "a", "y"), ("b1", "b", "z")], "chunk_id string, doc_id string, body string")
    S.replace_documents(rows, path)
    S.replace_documents(spark.createDataFrame([("a9", "a", "new")], "chunk_id string, doc_id string, body string"), path)
    assert {r["chunk_id"] for r in S.read_index(spark, path).collect()} == {"a9", "b1"}
    assert S.read_index(spark, path, ["b"]).count() == 1 and S.read_index(spark, path, []).count() == 2
    new = spark.createDataFrame([("a1", "s", "xx")], "chunk_id string, summary string, body string")
    got = {r["chunk_id"]: (r["body"], r["summary"]) for r in S.with_columns(rows, new, "chunk_id").collect()}
    assert got == {"a1": ("xx", "s"), "a2": ("y", None), "b1": ("z", None)}
    assert {r["chunk_id"] for r in S.without_stale(rows, rows.where("chunk_id = 'a1'"), "chunk_id", "doc_id").collect()} == {"a1", "b1"}


def test_payload_cache_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([("1",), ("2",), ("3",)], "chunk_id string")
    vec = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("1", ["a?", "b?"])], "chunk_id string, queries array<string>")
    got = {r["chunk_id"]: (r["embedding"], r["queries"]) for r in S.join_payload(chunks, vec, q).collect()}
    assert got == {"1": ([1.0, 0.0], "a?\nb?"), "2": (None, None), "3": (None, None)}
    asked = spark.createDataFrame([("m", "x"), ("m", "x"), ("m", None)], "model string, text string").withColumn("key", S.cache_key("model", "text"))
    assert S.cache_misses(asked, asked.limit(0)).count() == 2
    assert S.cache_misses(asked, asked.where("text is null")).count() == 1


def test_manifest(spark):
    rows = spark.createDataFrame([("a", "a1", 1), ("a", "a2", 2), ("b", "b1", 1), ("c", "c1", None)], "doc_id string, chunk_id string, page int")
    made = S.manifest(rows)
    assert {(r["doc_id"], r["version"], r["pages"], r["chunks"]) for r in made.collect()} == {("a", 1, 2, 2), ("b", 1, 1, 1), ("c", 1, 0, 1)}
    other = made.withColumn("version", F.when(F.col("doc_id") == "b", 0).otherwise(F.col("version"))).where("doc_id <> 'c'")
    assert {r["doc_id"] for r in S.unfinished(rows, other).collect()} == {"b", "c"}
    assert S.unfinished(rows, made).count() == 0 and S.manifest(rows.limit(0)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    rows = [(i, f"2031-01-01 0{i % 3}:10:00", "click" if i % 2 else "view", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = inbox.run_hourly(spark, str(tmp_path / "events.parquet"), "*.parquet")
    assert got.exceptAll(inbox.hourly(df)).count() == 0 and got.count() == 6


def test_inbox(spark, tmp_path):
    path, box = str(tmp_path / "index"), str(tmp_path / "inbox")
    rows = spark.createDataFrame([("a1", "a", "x")], "chunk_id string, doc_id string, body string")
    rows.write.parquet(box)
    inbox.watch_inbox(spark, box, path, str(tmp_path / "state"), rows.schema).awaitTermination()
    assert S.read_index(spark, path).count() == 1
    assert materialize(rows, "x").count() == 1
