"""Sparse vectors as MAP<INT, DOUBLE> columns over a hashed vocabulary: encoding, signatures, storage and search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = 1 << 20
SPARSE = T.MapType(T.IntegerType(), T.DoubleType())


def token(word: Column, size: int = VOCABULARY) -> Column:
    """A word's place in the vocabulary, by 28 bits of its MD5."""
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long") % size).cast("int")


def encode(docs: DataFrame, key: str, tokens: Column, size: int = VOCABULARY) -> DataFrame:
    """(key, sparse): ln(1 + count) of each token's place, in order of places; documents without tokens have an empty map.

    A document's map has at most as many entries as the vocabulary.
    """
    counts = docs.select(key, F.explode_outer(tokens).alias("_w")).groupBy(key, token(F.col("_w"), size).alias("_t")).agg(F.count("_w").alias("_n"))
    entry = F.when(F.col("_t").isNotNull(), F.struct("_t", F.round(F.log1p("_n"), 6).alias("w")))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("sparse"))


def signature(sparse: str | Column) -> tuple[Column, Column]:
    """Number of entries that are not 0, and the sum of all weights."""
    v = F.map_values(F.col(sparse) if isinstance(sparse, str) else sparse)
    return F.size(F.filter(v, lambda x: x != 0)), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6)


def postings(rows: DataFrame, key: str, sparse: str = "sparse") -> DataFrame:
    """(key, term, weight): the form in which sparse vectors are joined."""
    return rows.select(key, F.explode(sparse).alias("term", "weight"))


@dataclass(frozen=True)
class Collection:
    """What a stored collection holds: vectors of `dim` numbers, and sparse ones beside them if `hybrid`."""

    path: str
    dim: int
    hybrid: bool = False


def create(rows: DataFrame, spec: Collection, key: str, dense: str, sparse: str = "sparse", replace: bool = True) -> int:
    """Stores a collection and returns its number of rows; without `replace` one that is there is left as it is.

    A hybrid collection needs sparse vectors: an encoder that gives none is rejected. Vectors of another length fail.
    """
    kind = next((f.dataType for f in rows.schema if f.name == sparse), None)
    if spec.hybrid and kind != SPARSE:
        raise ValueError(f"{spec.path} is hybrid, but its rows have no sparse vectors")
    ok = F.coalesce(F.size(dense) == spec.dim, F.lit(False)) & ~F.exists(dense, lambda x: F.isnan(x) | x.isNull())
    vector = F.when(ok, F.col(dense)).otherwise(F.raise_error(F.lit(f"a vector is not of {spec.dim} numbers")))
    out = rows.select(key, vector.cast("array<double>").alias(dense), *([sparse] if spec.hybrid else []))
    out.write.mode("overwrite" if replace else "ignore").parquet(spec.path)
    return rows.sparkSession.read.parquet(spec.path).count()


def save_json(rows: DataFrame, key: str, sparse: str, path: str) -> None:
    """Sparse vectors beside dense ones: JSON lines with places as string keys."""
    rows.select(key, F.map_from_entries(F.transform(F.map_entries(sparse), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))).alias(sparse)).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, key: str, sparse: str = "sparse") -> DataFrame:
    raw = spark.read.schema(f"{key} long, {sparse} map<string,double>").json(path)
    back = F.transform(F.map_entries(sparse), lambda e: F.struct(e["key"].cast("int").alias("key"), e["value"].alias("value")))
    return raw.select(key, F.map_from_entries(F.array_sort(back)).alias(sparse))


def copy(spark: SparkSession, source: str, target: str) -> int:
    """Copies a collection and checks that as many rows arrive."""
    rows = spark.read.parquet(source)
    rows.write.mode("overwrite").parquet(target)
    n, m = rows.count(), spark.read.parquet(target).count()
    if n != m:
        raise RuntimeError(f"{n} rows read, {m} written")
    return m
