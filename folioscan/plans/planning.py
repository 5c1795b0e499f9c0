"""Which way a query goes: over all units, or over those that the index leaves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..query.parser import Query


def plan_queries(queries: DataFrame, text_col: str = "query", id_col: str = "query_id") -> DataFrame:
    """``(id_col, allowed, op, warnings)`` of a table of query texts; null and empty texts are not allowed, with op AND."""

    def run(batches):
        for pdf in batches:
            parsed = [Query(q) for q in pdf[text_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "allowed": [q.prefilter_allowed for q in parsed], "op": [q.prefilter_operator for q in parsed], "warnings": [q.warnings for q in parsed]})

    kind = queries.schema[id_col].dataType.simpleString()
    return queries.select(id_col, F.col(text_col)).mapInPandas(run, f"`{id_col}` {kind}, allowed boolean, op string, warnings array<string>")
