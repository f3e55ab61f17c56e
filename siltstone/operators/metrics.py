"""Retrieval metrics over long tables of ranked results and relevant pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ir_metrics(run: DataFrame, qrels: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """Per query: hit rate, recall, reciprocal rank and binary nDCG at k; run has rank from 1, qrels one row a pair."""
    gold = qrels.groupBy(query).agg(F.count(F.lit(1)).alias("n_gold"))
    return _scored(gold, run.where(F.col("rank") <= k).join(qrels.select(query, doc), [query, doc]), query, k)


def label_metrics(run: DataFrame, queries: DataFrame, rows: DataFrame, query: str, doc: str, label: str, k: int) -> DataFrame:
    """The same where every row of the query's label is relevant but the query, which is one of the rows; no pairs are made."""
    asked = queries.select(query, label)
    gold = asked.join(rows.groupBy(label).agg((F.count(F.lit(1)) - 1).alias("n_gold")).where("n_gold > 0"), label).select(query, "n_gold")
    return _scored(gold, run.where(F.col("rank") <= k).join(asked, query).join(rows.select(doc, label), [doc, label]), query, k)


def _scored(gold: DataFrame, hits: DataFrame, query: str, k: int) -> DataFrame:
    found = hits.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = gold.join(found, query, "left")
    return out.select(
        query, F.when(F.col("n") > 0, 1).otherwise(0).alias("hit"), F.round(F.coalesce(F.col("n"), F.lit(0)) / F.col("n_gold"), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def coverage(text: Column, entities: Column) -> Column:
    """Share of the entities that occur in the text, without regard to case; no entities give 0."""
    return F.when(F.size(entities) > 0, F.size(F.filter(entities, lambda e: F.contains(F.lower(text), F.lower(e)))) / F.size(entities)).otherwise(F.lit(0.0))


def budget_score(ranked: DataFrame, group: str, cov: str, budget: int) -> DataFrame:
    """Best coverage among the first `budget` ranks, discounted by log2(rank + 1), and undiscounted."""
    own = ranked.where(F.col("rank") <= budget)
    return own.groupBy(group).agg(F.round(F.max(F.col(cov) / F.log2(F.col("rank") + 1)), 6).alias("discounted"), F.round(F.max(cov), 6).alias("flat"))
