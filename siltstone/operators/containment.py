"""Texts that are contained in others, found by automata over blocks of the contained side.

Texts are compared in lower case with every run of white space as one blank. Equal texts are one class, whose copies are
counted and not expanded. The contained side is cut into blocks of bounded bytes by a hash; a block's texts form an
Aho-Corasick automaton that is sent to the tasks, and each text of the other side is read through it once. The other side
is never shuffled. Defined cases: null and blank texts take part on neither side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import ship, stored

BLOCK_BYTES = 8 << 20


def normal(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, text): the smallest key of each class of equal texts, and its size."""
    rows = df.select(F.col(key), normal(text).alias("text")).where("text <> ''")
    return rows.groupBy("text").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n")).select(key, "n", "text")


def contained(inner: DataFrame, outer: DataFrame, inner_key: str, outer_key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(inner_key, outer_key) for all texts of `inner` within a text of `outer`; both have (key, text) of distinct texts.

    Texts longer than every text of the other side are left out first.
    """
    spark = inner.sparkSession
    ship(spark)
    longest = outer.agg(F.max(F.octet_length("text"))).first()[0] or 0
    inner = inner.where(F.octet_length("text") <= longest)
    blocks = -(-(inner.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    kinds = f"{inner_key} {dict(inner.dtypes)[inner_key]}, {outer_key} {dict(outer.dtypes)[outer_key]}"
    found = [spark.createDataFrame([], kinds)]
    for b in range(blocks):
        block = inner.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).select(inner_key, "text").toPandas()  # about block_bytes
        sent = spark.sparkContext.broadcast(list(zip(block[inner_key].tolist(), block["text"], strict=True)))

        def scan(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            words = ahocorasick.Automaton()
            for key, text in sent.value:
                words.add_word(text, key)
            if sent.value:
                words.make_automaton()
            for pdf in frames:
                rows = [(k, o) for o, t in zip(pdf[outer_key], pdf["text"], strict=True) for k in dict.fromkeys(k for _, k in words.iter(t))] if sent.value else []
                yield pd.DataFrame(rows, columns=[inner_key, outer_key])

        found.append(outer.select(outer_key, "text").mapInPandas(scan, kinds))
    return reduce(DataFrame.unionByName, found)


def either_way(a: DataFrame, b: DataFrame, a_key: str, b_key: str, text: str = "text") -> DataFrame:
    """(a_key, its number of copies, b_key, its number of copies, relation): classes of `a` and `b` that are equal or contain one another."""
    a, b = stored(classes(a, a_key, text), "inner"), stored(classes(b, b_key, text), "outer")
    inside = contained(a, b, a_key, b_key).withColumn("a_in_b", F.lit(True))
    around = contained(b, a, b_key, a_key).withColumn("b_in_a", F.lit(True))
    both = stored(inside.join(around, [a_key, b_key], "full"), "pairs")
    relation = F.when(F.col("a_in_b") & F.col("b_in_a"), "equal").when(F.col("a_in_b"), f"{a_key} inside").otherwise(f"{b_key} inside")
    out = both.join(a.select(a_key, F.col("n").alias(f"{a_key}_copies")), a_key).join(b.select(b_key, F.col("n").alias(f"{b_key}_copies")), b_key)
    return out.select(a_key, f"{a_key}_copies", b_key, f"{b_key}_copies", relation.alias("relation"))
