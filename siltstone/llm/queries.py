"""The registered queries of the training-data operators, with production parameters, and their SQL where there is any."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import ann, crosstoken, langid, mixing, neardup, oracles, periodic, quality, ring, search, tokencount, unigram, urlfilter, warc
from siltstone.session import stored, table


def fold(key: str, n: int):
    """crc32 of the id's text modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op4_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.label(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: The tokenizer file of op7 and of the pipeline's last stage.
PIECES = os.environ.get("SILTSTONE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: How often the least represented source may be repeated for each time the most represented one is.
REPEATS = 2.0


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.tokens().alias("n_tokens")), "tokens")
    sources = stored(mixing.source_tokens(docs), "sources")
    plan = stored(mixing.budgets(mixing.weights(sources, repeats=REPEATS)), "plan")
    return mixing.schedule(docs, plan).withColumn("weight", F.round("weight", 9))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    entries = F.array_sort(F.map_entries("headers"))
    line = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "url_key", "ts", "source_id", "source_ts", "outcome", "status", line.alias("headers"))


def op3_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold("doc_id", 3) == 1
    model = quality.fit(docs, labels.where(~held))
    return quality.score(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.digest(docs, unigram.load(PIECES), keep=["doc_id"])


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.detect(table(spark, sf_dir, "documents"))


def op6_best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(docs, docs.where("doc_id % 20 = 0")).withColumn("score", F.round("score", 9))


#: The vocabulary of op9 and its pre-splitting pattern (a fixed value of that vocabulary).
RANKS = os.environ.get("SILTSTONE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def op9_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.per_line(docs, tokencount.load(RANKS, PATTERN), "most", keep=["doc_id"])
    total = F.aggregate("line_tokens", F.lit(0.0), lambda s, x: s + x)
    return counted.select("doc_id", "n_tokens", F.size("line_tokens").alias("n_lines"), total.alias("attributed"), F.array_max("line_tokens").alias("longest_line"), F.element_at("line_tokens", 1).alias("first_line"), F.element_at("line_tokens", -1).alias("last_line"))


def op10_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 100 = 0"), ann.fit(rows))


#: The number of shards of op11.
SHARDS = 40


def op11_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """What a tenth of the documents repeat, so that each table holds long runs; rows without an id keep their words."""
    if doc_id is None:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.detect(docs, planted, keep=["doc_id"]).drop("runs")


#: The tokenizer file A of op13; B is that of op7.
BYTES = os.environ.get("SILTSTONE_BYTES", "/opt/tokenizers/byte_bpe_50k.json")


def op13_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align(table(spark, sf_dir, "documents").select("doc_id", "text"), crosstoken.load(BYTES, PIECES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixture": op1_source_mixture,
    "op2_revisits": op2_revisits,
    "op3_quality_votes": op3_quality_votes,
    "op4_url_ratio": op4_url_ratio,
    "op5_language_id": op5_language_id,
    "op6_best_matches": op6_best_matches,
    "op7_pieces": op7_pieces,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_line_tokens": op9_line_tokens,
    "op10_partitions": op10_partitions,
    "op11_ring_shards": op11_ring_shards,
    "op12_word_runs": op12_word_runs,
    "op13_token_groups": op13_token_groups,
}

ORACLES: dict[str, str] = {
    "op1_source_mixture": oracles.MIXTURE,
    "op2_revisits": oracles.REVISITS,
    "op4_url_ratio": oracles.url_ratio(RULES),
    "op8_near_duplicates": oracles.NEAR_DUPLICATES,
    "op11_ring_shards": oracles.ring_shards(SHARDS),
    "op12_word_runs": oracles.WORD_RUNS,
}
