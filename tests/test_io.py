"""Sources, sinks, slots and streams."""

import uuid

import pytest
from pyspark.sql import functions as F

from siltstone.functions import slots
from siltstone.sources import files, paged
from siltstone.streaming import events


def test_spans_append(spark, tmp_path):
    p = str(tmp_path / "spans")
    row = spark.sql("SELECT timestamp'2024-01-01' timestamp, 'llm_call' span_name, 'r' role, 'm' model_name, 1 tokens_in, 2 tokens_out, 0.5 cost_usd, 9.0 duration_ms")
    files.append_spans(row, p)
    files.append_spans(row.withColumn("span_name", F.lit("tool")), p)
    assert files.read_spans(spark, p).count() == 2
    plan = files.read_spans(spark, p, "tool").select("cost_usd")._jdf.queryExecution().toString()
    assert "EqualTo(span_name,tool)" in plan and "ReadSchema: struct<span_name:string,cost_usd:double>" in plan
    assert files.read_spans(spark, p, "tool").count() == 1


def test_audit(spark, tmp_path):
    p = str(tmp_path / "audit")
    rows = spark.sql("SELECT '1' id, 'add' operation, 'u' user_id, map('a', 'b') metadata UNION ALL SELECT '2', 'delete', 'v', map()")
    files.append_audit(rows, p)
    assert [r["id"] for r in files.read_audit(spark, p, user_id="u").collect()] == ["1"]
    assert files.read_audit(spark, p, operation="delete").first()["user_id"] == "v"


def test_texts(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.md").write_text("no")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    assert [(r["stem"], r["text"]) for r in files.read_texts(spark, str(tmp_path)).collect()] == [("a", "hello\n")]
    got = files.signature(files.read_texts(spark, str(tmp_path)), "text").first()
    assert (got["size"], got["lines"], len(got["sha256_16"])) == (6, 1, 16)


def test_bundle_round_trip_and_old_versions(spark, tmp_path):
    m = spark.createDataFrame([("u", "c", "fact", 0.4), ("u", "d", "pref", None)], "user_id string, content string, type string, quality_score double")
    files.export_bundle(m, str(tmp_path / "b"))
    assert sorted((r["content"], r["quality_score"]) for r in files.import_bundle(spark, str(tmp_path / "b")).collect()) == [("c", 0.4), ("d", 1.0)]
    (tmp_path / "old.json").write_text('{"version":"1","user_id":"u","memories":[{"content":"x"}]}\n')
    assert files.import_bundle(spark, str(tmp_path / "old.json")).first()["type"] == "fact"


def test_vectors(spark):
    good = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert files.checked_vectors(good, "v", 2).count() == 1
    with pytest.raises(Exception, match="not of 3 numbers"):
        files.checked_vectors(good, "v", 3).collect()
    assert files.mode_of(good) == "dense"
    assert files.mode_of(good.withColumn("sparse", F.create_map(F.lit(1), F.lit(0.5)))) == "hybrid"


def test_corpus_and_resume(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(10)], "doc long, text string")
    qrels = spark.createDataFrame([("q", 7, 1), ("q", 8, 0), ("r", 99, 1)], "qid string, doc long, score int")
    corpus, gold = files.benchmark_corpus(docs, qrels, "doc", 4)
    assert sorted(r["doc"] for r in corpus.collect()) == [0, 1, 2, 7]
    assert [(r["qid"], r["gold"]) for r in gold.collect()] == [("q", [7])]
    assert files.not_yet(docs, corpus, "doc").count() == 6


def test_csv(spark, tmp_path):
    files.export_csv(spark.createDataFrame([(2, 0.12345678), (1, 1.0)], "a int, b double"), str(tmp_path / "c"), ["a"])
    assert [(r["a"], r["b"]) for r in spark.read.csv(str(tmp_path / "c"), header=True).orderBy("a").collect()] == [("1", "1.0"), ("2", "0.123457")]


def test_paged(spark):
    paged.register(spark)
    df = spark.read.format("paged").option("transport", "tests.paged_fixture:fetch").option("pages", "3").load()
    assert df.count() == 9 and df.agg(F.sum("views")).first()[0] == 99


def test_slots(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    size = slots.slot(lambda t: t.split()[1])
    got = df.select(size(F.col("t")).alias("r")).select("r.*").collect()
    assert (got[0]["ok"], got[0]["value"]) == (True, "b") and got[1]["error"].startswith("IndexError") and got[2]["value"] is None
    norms = df.select(F.aggregate(slots.hashed_encoder(8)("t"), F.lit(0.0), lambda s, x: s + x * x)).collect()
    assert abs(norms[0][0] - 1) < 1e-9 and norms[1][0] == 0
    slots.register_tool(spark, "shout", lambda t: t.upper(), "string")
    assert spark.sql("SELECT shout('a')").first()[0] == "A"


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), src.schema, 1)
    name = "w" + uuid.uuid4().hex[:8]
    q = events.windowed(stream, "40 days").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table(name).agg(F.sum("n")).first()[0] == src.count()
    held = {}
    sink = events.latest_state(lambda: held.get("t"), lambda df, epoch: held.__setitem__("t", spark.createDataFrame(df.collect(), df.schema)))
    q = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r[0]: r[1] for r in src.groupBy("user_id").agg(F.max("event_id")).collect()}
    assert {r["user_id"]: r["event_id"] for r in held["t"].collect()} == want
    assert events.sessions(events.read(spark, str(tmp_path / "in"), src.schema)).isStreaming


def test_stored_tables_can_be_cleared(spark):
    import os

    from siltstone import session

    session.clear(spark)
    df = session.stored(spark.range(5), "five")
    path = df.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert df.count() == 5 and os.path.exists(path)
    assert session.clear(spark) == 1
    assert not os.path.exists(path) and session.clear(spark) == 0
