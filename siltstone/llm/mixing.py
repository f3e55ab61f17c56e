"""Mixing sources to target weights, with DataFrame functions only.

1. `source_tokens`: whitespace-separated words of each source, summed in one pass.
2. `weights`: every source's share of the tokens is raised to one exponent in [0, 1] and normalised. The exponent is
   found by bisection: the largest one whose mixture reaches `entropy` (in nats), or the smallest one that repeats no
   source more than `repeats` times as often as the least repeated one. The bisection is one expression over the array
   of sources, which is bounded by `MAX_SOURCES` (checked; the query fails beyond it).
3. `schedule`: the budget is dealt to sources by weight, and each source gets whole epochs and a part of one. An epoch
   is a permutation of the source's documents by a hash of seed, epoch and id. Running token sums in permuted order come
   from three levels of hash ranges, so no window holds more than about 1 / 2^20 of a source and a hot source is spread
   over all tasks. The sums cut the last epoch at the budget and deal all sources side by side into blocks of about
   `block_tokens` tokens that each hold the mixture. Inside a block all sources' copies are permuted together by another
   60 bits of the hash, and `place` is a copy's position in that permutation: (block, place) orders the whole mixture.
4. `repeat`: the same decision for whole rows without a shuffle of their texts: the cut of a source is one position in
   its last epoch, found level by level, and joined back as one row per source.

Defined cases: a null source is a source of its own, shown as null. Null, empty and blank texts have no token, so they
take part in every whole epoch and in the last one up to the cut. A source without any token has weight 0, and each
of its rows comes once, in a block by hash. Documents of equal position (repeated rows) are taken or left together at the cut. Empty tables
give empty results. Input columns beyond id, source and text are kept by `repeat`; `schedule` does not look at them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.frames import free_names
from siltstone.session import stored

MAX_SOURCES = 100_000
BLOCK_TOKENS = 1 << 17
STEPS = 60
LEVEL = 1024  # hash ranges of a level


def tokens(text: str = "text") -> Column:
    """Whitespace-separated words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens) from a table with source and n_tokens."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def weights(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> DataFrame:
    """(source, n_docs, n_tokens, exponent, weight); give one of the two limits."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give either entropy or repeats")
    all_of = sources.agg(F.collect_list("n_tokens").alias("raw"))
    all_of = all_of.select(F.when(F.size("raw") <= MAX_SOURCES, F.col("raw")).otherwise(F.raise_error(F.lit("more sources than MAX_SOURCES"))).alias("raw"))
    all_of = all_of.select(F.array_sort(F.filter("raw", lambda n: n > 0)).alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda s, x: s + x)
    all_of = all_of.select(F.transform("n", lambda x: x / total).alias("p"))

    def far_enough(a: Column) -> Column:
        """Whether exponent `a` is low enough, so that a higher one may be tried."""
        if entropy is not None:
            z = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x, a))
            # -sum w ln w with w = p^a / z
            h = F.aggregate("p", F.lit(0.0), lambda s, x: s - F.pow(x, a) / z * (a * F.log(x) - F.log(z)))
            return h >= F.lit(float(entropy))
        # a source is repeated as p^(a - 1): the smallest share most often
        return F.pow(F.element_at("p", 1) / F.element_at("p", -1), a - 1) > F.lit(float(repeats))

    halves = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
        lambda s, _: F.when(far_enough((s["lo"] + s["hi"]) / 2), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
    )
    # 0 and 1 themselves are exact answers where the limit binds nowhere or cannot be met
    open_end = far_enough(F.lit(1.0)) if entropy is not None else ~far_enough(F.lit(0.0))
    best = F.when(open_end, F.lit(1.0 if entropy is not None else 0.0)).otherwise(halves["lo" if entropy is not None else "hi"])
    all_of = all_of.select("p", F.when(F.size("p") > 0, best).otherwise(F.lit(1.0)).alias("exponent"))
    z = F.aggregate("p", F.lit(0.0), lambda s, x: s + F.pow(x, F.col("exponent")))
    one = all_of.select("exponent", z.alias("z")).first()
    everything = sources.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    weight = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(everything), F.lit(one["exponent"])) / F.lit(one["z"])).otherwise(F.lit(0.0))
    return sources.select("source", "n_docs", "n_tokens", F.lit(one["exponent"]).alias("exponent"), weight.alias("weight"))


def budgets(weighted: DataFrame, budget: float | None = None) -> DataFrame:
    """Adds `tokens`: what each source may give. Without a budget every source comes once at least."""
    if budget is None:
        budget = weighted.agg(F.max(F.when(F.col("weight") > 0, F.col("n_tokens") / F.col("weight")))).first()[0] or 0.0
    give = F.round(F.col("weight") * F.lit(float(budget)), 0).cast("long")
    # rounding must not cost a source its last document
    give = F.when(F.col("n_tokens") > 0, F.when(F.abs(give - F.col("n_tokens")) <= 1, F.col("n_tokens")).otherwise(give)).otherwise(F.lit(0).cast("long"))
    return weighted.withColumn("tokens", give).withColumns({
        "whole": F.when(F.col("n_tokens") > 0, F.floor(F.col("tokens") / F.col("n_tokens"))).otherwise(F.lit(1)).cast("long"),
        "rest": F.when(F.col("n_tokens") > 0, F.col("tokens") % F.col("n_tokens")).otherwise(F.lit(0)).cast("long"),
    })


def place(seed: int, epoch: Column, key: str, first: int = 1) -> Column:
    """A document's position in the permutation of an epoch: 60 hash bits, from hexadecimal digit `first` on, as a number."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), first, 15), 16, 10).cast("long")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def schedule(docs: DataFrame, weighted: DataFrame, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, start, block, place) of each taken copy; docs has key, source, n_tokens.

    `start` is the number of tokens of the source before the copy, `block` the block it is dealt to, `place` its position
    in the block, from 1.
    """
    # the blocks grow in number with the budget, so that one of them stays small
    n_blocks = max(1, -(-int(weighted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) // block_tokens))
    plan = weighted.select(F.col("source").alias("_s"), "weight", "tokens", "whole", "rest", F.col("n_tokens").alias("_n"))
    few = F.broadcast(plan)  # bounded by MAX_SOURCES
    rows = docs.select(F.col(key).alias("doc_id"), "source", "n_tokens").join(few, _same("source", "_s"))
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    rows = rows.where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumns({"at": place(seed, F.col("epoch"), "doc_id"), "mixed": place(seed, F.col("epoch"), "doc_id", 16)})
    rows = rows.withColumns({"r1": F.shiftright("at", 50), "r2": F.shiftright("at", 40)}).drop("_s")
    rows = stored(rows, "placed")
    # running sums over the ranges: coarse ranges of an epoch, fine ranges of a coarse one, rows of a fine one
    fine = stored(rows.groupBy("source", "epoch", "r1", "r2").agg(F.sum("n_tokens").alias("t")), "ranges")
    coarse = fine.groupBy("source", "epoch", "r1").agg(F.sum("t").alias("t"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("source", "epoch").orderBy("r1").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("source", "epoch", "r1", before.alias("b1"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("source", "epoch", "r1").orderBy("r2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fine = fine.select("source", "epoch", "r1", "r2", before.alias("b2"))
    c, f = coarse.alias("c"), fine.alias("f")
    both = f.join(c, F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f.epoch") == F.col("c.epoch")) & (F.col("f.r1") == F.col("c.r1")))
    both = both.select(F.col("f.source").alias("_s"), F.col("f.epoch").alias("_e"), F.col("f.r2").alias("_r"), (F.col("b1") + F.col("b2")).alias("b"))
    own = F.sum("n_tokens").over(W.partitionBy("source", "epoch", "r2").orderBy("at")) - F.sum("n_tokens").over(W.partitionBy("source", "epoch", "r2", "at"))
    rows = rows.withColumn("inside", own).join(both, _same("source", "_s") & (F.col("epoch") == F.col("_e")) & (F.col("r2") == F.col("_r")))
    rows = rows.withColumn("from_epoch", F.col("b") + F.col("inside"))
    taken = rows.where((F.col("epoch") < F.col("whole")) | (F.col("from_epoch") < F.col("rest")))
    start = F.col("epoch") * F.col("_n") + F.col("from_epoch")
    by_tokens = F.least(F.floor(start * n_blocks / F.greatest(F.col("tokens"), F.lit(1))), F.lit(n_blocks - 1))
    by_hash = F.shiftright(F.shiftright("at", 20) * n_blocks, 40)  # of 60 bits the upper 40
    block = F.when(F.col("tokens") > 0, by_tokens).otherwise(by_hash)
    taken = taken.select("doc_id", "source", "n_tokens", "weight", "epoch", start.alias("start"), block.cast("long").alias("block"), "mixed")
    order = W.partitionBy("block").orderBy("mixed", "doc_id", "source", "epoch", "n_tokens")
    return taken.select("doc_id", "source", "n_tokens", "weight", "epoch", "start", "block", F.row_number().over(order).alias("place"))


def cuts(rows: DataFrame, weighted: DataFrame, seed: int = 1) -> DataFrame:
    """(source, whole, cut): copies of each row, and the position in the last epoch below which a row comes once more.

    rows has doc_id, source and n_tokens. The cut is found by narrowing the range of positions that holds the budget's
    end, LEVEL ranges at a time; only rows in the range found so far are summed again.
    """
    plan = weighted.select(F.col("source").alias("_s"), "whole", "rest")
    at = rows.join(F.broadcast(plan), _same("source", "_s")).where("rest > 0").select("source", "n_tokens", "whole", "rest", place(seed, F.col("whole"), "doc_id").alias("at"))
    left = plan.select(F.col("_s").alias("source"), "whole", F.lit(0).cast("long").alias("prefix"), "rest").where("rest > 0")
    for bits in (50, 40, 30, 20, 10, 0):
        mine = left.select(F.col("source").alias("_s"), "prefix", F.col("rest").alias("_rest"))
        part = at.join(F.broadcast(mine), _same("source", "_s") & (F.shiftright("at", bits + 10) == F.col("prefix")))
        sums = part.groupBy("source", F.shiftright("at", bits).alias("r")).agg(F.sum("n_tokens").alias("t"), F.first("_rest").alias("_rest"))
        before = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # the range in which the sum passes what is left
        hit = sums.withColumn("b", before).where((F.col("b") < F.col("_rest")) & (F.col("b") + F.col("t") >= F.col("_rest")))
        hit = hit.groupBy("source").agg(F.min(F.struct("r", "b", "_rest")).alias("h"))
        left = stored(hit.select("source", F.col("h.r").alias("prefix"), (F.col("h._rest") - F.col("h.b")).alias("rest")), "cut")
    end = left.select(F.col("source").alias("_e"), F.col("prefix"))
    return plan.join(end, _same("_s", "_e"), "left").select(F.col("_s").alias("source"), "whole", F.coalesce("prefix", F.lit(-1)).cast("long").alias("cut"))


def repeat(docs: DataFrame, weighted: DataFrame, cut: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 1) -> DataFrame:
    """Whole rows, each as often as the mixture takes it; the rows are not shuffled."""
    s, w, c, copy = free_names(docs, "_source", "_whole", "_cut", "_copy")
    few = F.broadcast(cut.select(F.col("source").alias(s), F.col("whole").alias(w), F.col("cut").alias(c)))  # bounded by MAX_SOURCES
    times = F.col(w).cast("int") + (place(seed, F.col(w), key) <= F.col(c)).cast("int")
    return docs.join(few, F.col(source).eqNullSafe(F.col(s))).where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*[f"`{x}`" for x in docs.columns])
