"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next.

The stages that learn read the labels beside the documents: language ID learns from `lang` of the documents it is given,
the quality classifier from `labels` joined with the documents it is given.

Defined cases, for every stage: an empty table gives an empty table. All columns of the input are kept, extra ones as
well; a column may have any name, that of a model's output included. Null, empty and letterless texts go with the first
stage; very long texts are read whole. Rows without an id are filtered, deduplicated and mixed like any other (they are
only never learnt from). Repeated rows, whether their ids are equal or missing, are copies: one of each group stays, the
one with the smallest id, then the smallest position in the table. Null sources are a source of their own. Ties are
defined by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import langid, mixing, neardup, quality, unigram
from siltstone.llm.frames import free_names
from siltstone.llm.queries import PIECES, REPEATS
from siltstone.session import shared_path, stored, table

#: A document stays if its language is known and holds this share of the letters' probability at least.
LEAST_SHARE = 0.3


def columns_of(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a leading language go."""
    lang, share = free_names(docs, "lang_pred", "score")
    found = langid.label(docs, langid.fit(docs), out=(lang, share))
    return found.where((F.col(lang) != langid.UND) & (F.col(share) >= LEAST_SHARE)).select(*columns_of(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents voted to be of low quality go."""
    share, good = free_names(docs, "score", "predicted")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out=(share, good)).where(F.col(good) == 1).select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, the one with the smallest id.

    Rows are told apart by their position, written down once, since ids may be repeated or missing.
    """
    (row,) = free_names(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = stored(neardup.detect(rows, row).select(F.col("doc_id").alias("_at"), "component_id"), "groups")
    ids = rows.select(F.col(row).alias("_at"), F.col("doc_id").cast("long").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_at")
    best = groups.join(ids, "_at").groupBy("component_id").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    gone = groups.join(best, "component_id").where("_at <> _best._at").select(F.col("_at").alias(row))
    return rows.join(stored(gone, "gone"), row, "left_anti").select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document comes once at least; documents of smaller sources come up to REPEATS times."""
    rows = stored(docs.select("doc_id", "source", mixing.tokens().alias("n_tokens")), "tokens")
    plan = stored(mixing.budgets(mixing.weights(stored(mixing.source_tokens(rows), "sources"), repeats=REPEATS)), "plan")
    return mixing.repeat(docs, plan, mixing.cuts(rows, plan))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, beside what a decoder needs to check them."""
    out = unigram.encode(docs.select("doc_id", "lang", "source", "text"), unigram.load(PIECES))
    return out.select("doc_id", "lang", "source", F.size("ids").alias("n_pieces"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Trained models and piece tables are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
