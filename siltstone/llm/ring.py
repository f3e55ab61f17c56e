"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `VNODES` points of a ring of 60-bit positions. A key goes to the shard of the first point clockwise of
its own position. A shard that has reached its limit takes no more: keys that overflow it continue clockwise to the next
point of a shard with room. The order in which a full shard takes keys is defined without any arrival order, so that the
outcome does not depend on how the table is read: those it takes in an earlier round of walking come first, and within
a round those of lower priority, which is another 60 bits of the key's hash.

With `slack` = 0 the limits add up to the number of rows, so all shards are full in the end and their counts are at
most one apart. With a positive slack no shard gets more than ceil((1 + slack) * rows / shards).

When shards are added, a key keeps its shard unless a point of a new shard now comes first, or it is beyond a limit,
before or after. The limits move few keys, since many points give shards of about equal arcs; a shard whose limit falls
gives up its keys of highest priority only.

How it runs: a round looks up the ring by a broadcast table of its cells (its size depends on `VNODES` and the shards
alone), sorts narrow rows by (shard, priority) over ranges, numbers them from the counts of the ranges, and stores them.
Only what overflows goes on to the next round. A round fills one shard at least, so there are at most as many rounds as
shards; each is a few per cent of the one before. The place in that numbering is also the row's slot in its shard.

Defined cases: null texts have 0 bytes and a null checksum; empty texts have 0 bytes and checksum 0; long texts are read
whole where they lie and not moved. Null ids are one key. Repeated ids are one key of many rows: they share one position
and one priority, go on together, and are split where a limit falls among them by checksum, size and place in the table
(rows equal in all that are alike in the result too). An empty table gives an empty table; fewer rows than shards leave
shards empty. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.ranking import positions
from siltstone.session import stored

VNODES = 512
BITS = 60
CELL_BITS = 12  # of the lookup table


def points(shards: int, vnodes: int = VNODES, seed: int = 1) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in order."""
    spot = lambda s, v: int(hashlib.md5(f"{seed}:{s}:{v}".encode()).hexdigest()[:15], 16)
    return sorted((spot(s, v), s) for s in range(shards) for v in range(vnodes))


def cells(ring: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(cell, points that keys of this cell can meet first): those inside the cell and the next one clockwise of it."""
    spots, out = [p for p, _ in ring], []
    for cell in range(1 << CELL_BITS):
        i, j = (bisect_left(spots, (cell + x) << (BITS - CELL_BITS)) for x in (0, 1))
        # positions are under 2^60, so the last point of a cell stands for all that comes after it
        out.append((cell, [*ring[i:j], (1 << BITS, ring[j % len(ring)][1])]))
    return out


def limits(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may take."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _bits(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def keys_of(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, size, text_crc32, spot, priority, row): all that placing needs of a table with doc_id and text."""
    text = F.col("text").cast("string")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("_d"))
    return rows.select("doc_id", "size", "text_crc32", _bits("_d", 1).alias("spot"), _bits("_d", 16).alias("priority"), F.monotonically_increasing_id().alias("row"))


def _per_shard(values: list[int], shard: str) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col(shard) + 1)


def place(spark: SparkSession, keys: DataFrame, shards: int, slack: float = 0.0, vnodes: int = VNODES, seed: int = 1) -> DataFrame:
    """The rows of `keys_of` with shard and slot (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("at least one shard")
    left, parts, ring = stored(keys, "keys"), [], points(shards, vnodes, seed)
    room, filled = limits(left.count(), shards, slack), [0] * shards
    kind = T.StructType([T.StructField("_cell", T.LongType()), T.StructField("_near", T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("s", T.IntegerType())])))])
    names = left.columns
    while any(room):
        near = spark.createDataFrame(cells([x for x in ring if room[x[1]]]), kind, verifySchema=False)
        at = left.join(F.broadcast(near), F.shiftright("spot", BITS - CELL_BITS) == F.col("_cell"))
        shard = F.element_at(F.filter("_near", lambda x: x["p"] >= F.col("spot")), 1)["s"]
        ranked, asked = positions(at.select(*names, shard.alias("shard")), ["shard"], ["priority", "doc_id", "text_crc32", "size", "row"], "rank")
        fits = F.col("rank") < _per_shard(room, "shard")
        parts.append(ranked.where(fits).select(*names, "shard", (F.col("rank") + _per_shard(filled, "shard")).alias("slot")))
        wants = {r["shard"]: r["n"] for r in asked.collect()}  # one row a shard
        over = any(n > room[x] for x, n in wants.items())
        took = [min(wants.get(x, 0), room[x]) for x in range(shards)]
        room, filled = [r - t for r, t in zip(room, took, strict=True)], [f + t for f, t in zip(filled, took, strict=True)]
        if not over:
            break
        left = ranked.where(~fits).select(*names)
    if not parts:
        return left.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    return reduce(DataFrame.unionByName, parts)


def shard(docs: DataFrame, shards: int, slack: float = 0.0, vnodes: int = VNODES, seed: int = 1) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of a table with doc_id and text.

    The law is `rows` where slack is 0; with a positive slack only an upper bound holds and the law is null. A ring with
    limits looks at all rows, so it is no law of keys alone and grown_shard is always null.
    """
    out = place(docs.sparkSession, keys_of(docs, seed), shards, slack, vnodes, seed)
    law = F.lit("rows" if slack == 0 else None).cast("string")
    return out.select("doc_id", "size", "text_crc32", law.alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
