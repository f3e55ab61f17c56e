"""All registered queries: name, function of (spark, sf_dir), and the same result as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import answers, evidence, graphs, retrieval, rules, stages, state, telemetry, text

GROUPS = [telemetry, retrieval, text, state, graphs, rules, answers, evidence, stages]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for g in GROUPS for name, f in g.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.ORACLES.items()}
