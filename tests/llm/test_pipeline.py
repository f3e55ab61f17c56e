"""The pipeline against its stages' own brute-force versions, and the registered queries on the smallest tables."""

import pytest
from pyspark.sql import functions as F
from siltstone.llm import queries
from tests.llm.test_search import groups
from tests.oracle import SF, compare

import corpus_pipeline as cp


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    compare(spark, name)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "", None, None, None), (10**6 + 2, "12 34", "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        new = spark.read.parquet(path)
        if k < 4:
            assert new.columns == columns
        if name == "language ID":
            assert new.where(F.col("doc_id") >= 10**6).count() == 0 and new.count() > 0.95 * docs.count() - 5
        if name == "quality classifier":
            marked = spark.read.parquet(f"{SF}/labels.parquet").join(docs.select("doc_id"), "doc_id")
            kept = marked.join(new.select("doc_id"), "doc_id", "left_semi")
            assert kept.where("quality = 1").count() >= 0.97 * marked.where("quality = 1").count()
            assert kept.where("quality = 0").count() <= 0.2 * max(1, marked.where("quality = 0").count())
        if name == "MinHash near-dedup":
            want = groups({r["doc_id"]: r["text"] for r in docs.collect()})
            assert {r["doc_id"] for r in new.collect()} == {i for i, g in want.items() if g[2]}
        if name == "mixing sources to target weights":
            assert docs.select("doc_id").subtract(new.select("doc_id")).count() == 0
        if k == 4:
            assert new.count() == docs.count() and new.where("n_pieces <> size(ids)").count() == 0
        docs = new


def test_run_equals_its_stages(spark):
    """run() gives what the stages give one after another, each on what its predecessor has kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), "stage")
    key = lambda r: (r["doc_id"], r["lang"], r["source"], r["n_pieces"], tuple(r["ids"]))
    assert sorted(map(key, cp.run(spark, SF).collect()), key=repr) == sorted(map(key, docs.collect()), key=repr)


def test_repeated_rows_and_user_columns(spark):
    """Rows without or with repeated ids are copies like any other, and no column of the user's is overwritten."""
    good = "The calm river runs along the old town, and people walk by it every day of the year with their dogs and friends."
    other = "Another calm page about gardens and their trees in spring, written with care for readers who love plants a lot."
    rows = [(None, good), (None, good), (None, other), (5, good), (5, good), (3, good), (8, other), (9, None), (9, ""), (10, "12 34")]
    names = "doc_id long, text string, lang string, source string, n_chars int, score string, predicted string, lang_pred string, ids string, _row string, _copy string"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", "c", "d", "e", "f") for i, t in rows], names)
    kept = cp.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.where("length(text) > 10").collect())) == [3, 8]
    assert kept.where("text IS NULL OR length(text) < 10").count() == 3
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} <= {("a", "b", "c", "d", "e", "f")}
    assert {r["doc_id"] for r in cp.identify_language(spark, docs, SF).collect()} == {None, 3, 5, 8}
    assert cp.encode_pieces(spark, docs, SF).count() == len(rows)


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0
