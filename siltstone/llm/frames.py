"""Shared plumbing of the operators in this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.session import ship


#: Rows that are worked on at once, so that results of a batch do not all lie in memory.
ROWS = 1024


def give_back() -> None:
    """Returns freed memory to the system: Python workers are kept between stages and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside gets Arrow batches of at most `rows` rows, so that neither side of the socket holds a large one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None) -> DataFrame:
    """`df` with columns computed from Arrow batches; `make` runs once per task and returns the batch function.

    The batch function sees all columns of `df`. One that has the name of a new one is then replaced. Of the others only
    those in `keep` are sent back, where it is given: texts need not cross the socket twice.
    """
    ship(df.sparkSession)
    new = {f.name for f in fields}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name not in new and (keep is None or f.name in keep)]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches):
        apply = None
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(i, ROWS)
                    apply = apply or make()
                    made = [pa.array(x, kind) for x, kind in zip(apply(batch), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *made], names=names)
        finally:
            del apply
            give_back()

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores before it as make it free in `df`."""
    out = []
    for name in wanted:
        while name in df.columns or name in out:
            name = "_" + name
        out.append(name)
    return out


def key_share(key, fraction):
    """A condition that holds for about `fraction` of the distinct keys, always the same ones."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.floor(F.lit(1 << 30) * fraction)
