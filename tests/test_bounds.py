"""Word boundaries of `query_type` beside letters with accents, as its SQL has them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.operators import routing


@pytest.mark.parametrize("text", ["warn SSälich keitst", "warn äSS keitst", "warn xSS keitst", "see 5 percentö there", "in Acmé Bölt", "x Acme Boltö"])
def test_boundaries_are_those_of_sql(spark, text):
    want = duckdb.execute("SELECT regexp_matches(?, ?)", [text, routing.DISTINCTIVE]).fetchone()[0]
    kind = spark.createDataFrame([(text,)], "text string").select(routing.query_type(F.col("text"))).first()[0]
    assert kind == ("kw" if want else "vec")
