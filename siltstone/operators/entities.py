"""Lookup of nodes by the entities they mention, in three tiers: exact, as a part of an entity, by the query's words.

Substrings are found through an index of the entities' runs of three letters (and of two and one, for short queries). A
query or word is looked up by its rarest run alone, and what has that run is then compared in full. So the work follows
the rarest run's entities, not queries times entities.

`index` has (entity, node), one row a mention. Only the first tier that finds anything counts for a query. Defined cases:
case does not matter; blank queries and queries without a word of three letters find nothing beyond the tiers before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import all_words
from siltstone.operators import retrieval
from siltstone.session import stored

RUN = 3


def runs(text: str, size: int = RUN) -> Column:
    """Distinct substrings of `size` letters of a short text; none if it is shorter."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, name) where the name contains the part; both tables have distinct texts in a column of their name."""
    pieces = names.select("name", F.explode(F.array_distinct(F.flatten(F.array(*(runs("name", k) for k in range(1, RUN + 1)))))).alias("run"))
    often = stored(pieces.groupBy("run").agg(F.count(F.lit(1)).alias("_n")), "runs")
    longest = names.agg(F.max(F.length("name"))).first()[0] or 0
    whole = F.when(F.length("part") < RUN, F.array("part")).otherwise(runs("part"))
    asked = parts.where(F.length("part").between(1, longest)).select("part", F.explode(whole).alias("run"))
    # a run that no name has rules its part out
    rare = asked.join(often, "run", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "run")).alias("_r")).where("_r.n > 0")
    return rare.select("part", F.col("_r.run").alias("run")).join(pieces, "run").where(F.contains("name", F.col("part"))).select("part", "name")


def find_nodes(index: DataFrame, queries: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """(key, tier, node, n, rank): up to `most` nodes a query, by number of entities (or of words met in them), then by node."""
    index = stored(index.select(F.lower("entity").alias("name"), "entity", "node").distinct(), "mentions")
    q = stored(queries.where(F.trim(text) != "").select(key, F.lower(text).alias("part")), "asked")
    exact = q.join(index.select(F.col("name").alias("part"), "node").distinct(), "part").select(key, F.lit(1).alias("tier"), "node", F.lit(1).cast("long").alias("n"))
    rest = stored(q.join(exact.select(key).distinct(), key, "left_anti"), "rest")
    names = index.select("name").distinct()
    within = rest.join(containing(names, rest.select("part").distinct()), "part").join(index, "name").groupBy(key, "node").agg(F.count(F.lit(1)).alias("n"))
    within = stored(within.select(key, F.lit(2).alias("tier"), "node", "n"), "within")
    rest = rest.join(within.select(key).distinct(), key, "left_anti")
    words = rest.select(key, F.explode(F.filter(all_words("part"), lambda w: F.length(w) > 2)).alias("part")).groupBy(key, "part").agg(F.count(F.lit(1)).alias("_times"))
    words = stored(words, "words")
    # mentions of a word by a node are summed once for all queries that have it
    met = containing(names, words.select("part").distinct()).join(index, "name").groupBy("part", "node").agg(F.count(F.lit(1)).alias("_m"))
    by_word = words.join(met, "part").groupBy(key, "node").agg(F.sum(F.col("_times") * F.col("_m")).alias("n")).select(key, F.lit(3).alias("tier"), "node", "n")
    return retrieval.top_k(exact.unionByName(within).unionByName(by_word), [key], [F.desc("n"), F.col("node")], most)
