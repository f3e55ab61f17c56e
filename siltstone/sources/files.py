"""Files in and out: append-only Parquet and JSON lines, text trees, exports and signatures.

Appends are true appends (no read-modify-write) and each job commits as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT = "id string, timestamp string, operation string, actor_agent_id string, user_id string, target_id string, new_id string, payload_summary string, metadata map<string,string>"
SPANS = "timestamp timestamp, span_name string, role string, model_name string, tokens_in bigint, tokens_out bigint, cost_usd double, duration_ms double"


def append_spans(df: DataFrame, path: str) -> None:
    df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(SPANS)]).write.mode("append").parquet(path)


def read_spans(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Spans of one name; filter and columns reach the Parquet scan."""
    df = spark.read.schema(SPANS).parquet(path)
    return df.where(F.col("span_name") == name) if name else df


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, user_id: str | None = None, operation: str | None = None) -> DataFrame:
    df = spark.read.schema(AUDIT).json(path)
    for column, value in (("user_id", user_id), ("operation", operation)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped and broken ones give nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, path, text) of whole text files below a folder, but for hidden ones and those that are no UTF-8."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return df.select(stem.alias("stem"), "path", text.alias("text")).where(~F.col("path").rlike(r"/\.[^/]") & F.col("text").isNotNull())


def signature(df: DataFrame, content: str) -> DataFrame:
    """Hash, size and number of lines of each row's content."""
    c = F.col(content)
    return df.withColumns({"sha256_16": F.substring(F.sha2(c, 256), 1, 16), "size": F.octet_length(c), "lines": F.regexp_count(c.cast("string"), F.lit("\n"))})


def export_csv(df: DataFrame, path: str, order: list[str], digits: int = 6) -> None:
    """CSV with a header; rows keep the order across files by range, so no single task writes them all."""
    shown = df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])
    shown.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


BUNDLE = "version string, user_id string, memories array<struct<content:string,type:string,quality_score:double>>, audit_log array<string>"


def export_bundle(memories: DataFrame, path: str) -> None:
    """One JSON line a user: all memories of (user_id, content, type, quality_score), version 3."""
    rows = memories.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("content", "type", "quality_score"))).alias("memories"))
    rows.select(F.lit("3").alias("version"), "user_id", "memories", F.array().cast("array<string>").alias("audit_log")).write.mode("overwrite").json(path)


def import_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Memories of bundles of versions 1 to 3: version 1 has no type and no score, version 2 no score."""
    rows = spark.read.schema(BUNDLE).json(path).select("user_id", F.col("version").cast("int").alias("version"), F.explode("memories").alias("m"))
    kind = F.when(F.col("version") < 2, "fact").otherwise(F.coalesce("m.type", F.lit("fact")))
    score = F.when(F.col("version") < 3, 1.0).otherwise(F.coalesce("m.quality_score", F.lit(1.0)))
    return rows.select("user_id", F.col("m.content").alias("content"), kind.alias("type"), score.alias("quality_score"))


def not_yet(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that a resumed load still has to write."""
    return df.join(done.select(key), key, "left_anti")


def checked_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fails on a vector of another length or with a component that is no number."""
    ok: Column = (F.size(vector) == dim) & ~F.exists(vector, lambda x: F.isnan(x))
    return df.withColumn(vector, F.when(ok, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} numbers"))))


def mode_of(df: DataFrame, sparse: str = "sparse") -> str:
    """`hybrid` if the table has a sparse vector column, else `dense`."""
    return "hybrid" if any(f.name == sparse and isinstance(f.dataType, T.MapType) for f in df.schema) else "dense"


def benchmark_corpus(docs: DataFrame, qrels: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """All relevant documents (score > 0) and filler by id up to `size`, and the relevant ones of each query."""
    gold = qrels.where("score > 0")
    own = docs.join(gold.select(key).distinct(), key, "left_semi")
    rest = max(0, size - own.count())
    filler = docs.join(gold.select(key).distinct(), key, "left_anti").orderBy(key).limit(rest)
    kept = gold.join(docs.select(key), key, "left_semi").groupBy("qid").agg(F.array_sort(F.collect_set(key)).alias("gold"))
    return own.unionByName(filler), kept
