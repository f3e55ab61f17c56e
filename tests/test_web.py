"""Fetching, search results, paged counts with redirects, and consolidation that survives a stop between its writes."""

import pytest
from pyspark.sql import functions as F
from siltstone.operators import graph
from siltstone.sources import web
from siltstone.streaming import consolidation


def test_fetching_keeps_rows_and_errors(spark):
    def transport(url):
        if "bad" in url:
            raise OSError("refused")
        return f"page of {url}"

    urls = [f"http://h.org/{i}" for i in range(7)] + ["http://bad.org/", "file:///etc/x", None, "HTTPS://h.org/8"]
    got = web.fetch_all(spark.createDataFrame(list(enumerate(urls)), "ix int, url string"), "ix", "url", transport, workers=99).orderBy("ix").collect()
    assert [r.url for r in got] == urls
    assert [r.ok for r in got] == [True] * 7 + [False] * 3 + [True]
    assert got[7].error == "OSError: refused" and "scheme" in got[8].error and "scheme" in got[9].error
    assert all(r.content == f"page of {r.url}" for r in got if r.ok)


def test_search_results(spark):
    rows = [("q", p, i, f"u{(p * 30 + i) % 50}") for p in range(5) for i in range(30)] + [("r", 0, 0, None), ("r", 0, 1, "only")]
    hits = spark.createDataFrame(rows, "query string, page int, place int, url string")
    assert [r.url for r in web.search_results(hits, "query", 4).where("query = 'q'").orderBy("rank").collect()] == ["u0", "u1", "u2", "u3"]
    assert web.search_results(hits, "query", 500).groupBy("query").count().collect() is not None
    assert {r["query"]: r["count"] for r in web.search_results(hits, "query", 500).groupBy("query").count().collect()} == {"q": 50, "r": 1}
    assert {r["query"]: r["count"] for r in web.search_results(hits, "query", -3).groupBy("query").count().collect()} == {"q": 1, "r": 1}


def test_paged_counts_with_redirects(spark):
    moved = [("apple inc.", "Apple Inc"), ("iphone", "IPhone"), ("IPhone", "Iphone (device)")]
    counts = {"Apple Inc": 7, "Iphone (device)": 9, "Pear": 1}

    def transport(names, token):
        if "broken" in names:
            raise ValueError("no")
        at = int(token or 0)
        part = dict(list(counts.items())[at : at + 1])  # one count an answer
        return {"moved": moved, "counts": part, "next": str(at + 1) if at + 1 < len(counts) else None}

    titles = spark.createDataFrame([("apple inc.",), ("iphone",), ("Pear",), ("unknown",), ("Apple Inc",)], "title string").coalesce(1)
    got = web.paged_counts(titles, "title", transport).cache()
    final = graph.resolved(got.where("kind = 'moved'").select(F.col("name").alias("from"), "to"))
    views = graph.views_of(titles, final, got.where("kind = 'count'").select(F.col("name").alias("title"), F.col("n").alias("views")))
    ends = {r.title: r.final for r in views.collect()}
    assert ends == {"apple inc.": "Apple Inc", "iphone": "Iphone (device)", "Pear": "Pear", "unknown": "unknown", "Apple Inc": "Apple Inc"}
    assert {r.name: r.n for r in got.where("kind = 'count'").collect()} == counts
    assert web.paged_counts(spark.createDataFrame([("broken",)], "title string"), "title", transport).first().kind == "error"


def test_consolidation_stopped_between_its_writes(spark, tmp_path):
    source, folder, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    schema = "scroll string, text string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    sink = consolidation.consolidator(folder, F.length("text") / 10, threshold=0.5)
    put([("Q-1", "short"), ("Q-2", "no"), ("Q-1", "short")])
    consolidation.start(stream(), folder, marks, sink, timeout_s=120)
    put([("Q-2", "no"), ("Q-10", "long enough"), (None, "x")])

    class Half:
        """Writes the facts of a batch and stops before its ids."""

        def __call__(self, batch, n):
            original = consolidation.earlier
            sink(batch, n)
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/processed/batch={n}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            assert original is consolidation.earlier
            raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        consolidation.start(stream(), folder, marks, Half()).awaitTermination(120)
    assert spark.read.parquet(f"{folder}/processed").count() == 2
    consolidation.start(stream(), folder, marks, sink, timeout_s=120)
    put([("Q-10", "long enough"), ("Q-1", "again")])
    consolidation.start(stream(), folder, marks, sink, timeout_s=120)
    facts = {r.scroll: (r.text, r.promoted) for r in spark.read.parquet(f"{folder}/facts").collect()}
    assert facts == {"Q-1": ("short", True), "Q-2": ("no", False), "Q-10": ("long enough", True)}
    assert spark.read.parquet(f"{folder}/facts").count() == spark.read.parquet(f"{folder}/processed").count() == 3


def test_oldest_scrolls_first(spark, tmp_path):
    batch = spark.createDataFrame([(f"Q-{i}", "t") for i in (100, 20, 3, 11)], "scroll string, text string")
    consolidation.consolidator(str(tmp_path), F.lit(1.0), most=2)(batch, 0)
    assert {r.scroll for r in spark.read.parquet(f"{tmp_path}/facts").collect()} == {"Q-3", "Q-11"}
    consolidation.consolidator(str(tmp_path), F.lit(1.0), most=9)(batch, 1)
    assert spark.read.parquet(f"{tmp_path}/processed").count() == 4
