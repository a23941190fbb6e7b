"""Chains of operators over streams.

Filters, extensions, renamings, casts and splits look at one row at a time, so they hold for a
stream as they do for a table. A grouped summary holds with a watermark on an event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.values import QueryError
from quillon.operators.relation import Relation
from quillon.operators.scopes import GroupScope, column, values

ROWWISE = {"where", "where_not", "extend", "rename"}


def rowwise(stream: DataFrame, steps: list[tuple[str, object]]) -> DataFrame:
    """A stream after steps such as ("where", "salary > 10") or ("extend", {"x": "a + b"})."""
    relation = Relation.bind(stream, trusted=True)
    for name, given in steps:
        if name not in ROWWISE:
            raise QueryError(f"{name} needs more than one row at a time")
        relation = getattr(relation, name)(given)
    return relation.df


def windowed(stream: DataFrame, time: str, window: str, late: str, keys: list[str], named) -> DataFrame:
    """Aggregates of each key in each tumbling window of event time; rows later than the
    watermark allows are left out."""
    relation = Relation.bind(stream, trusted=True)
    found = values(relation._named(named), GroupScope(relation))
    return (
        relation.df.withColumn("_event", column(time).cast("timestamp"))
        .withWatermark("_event", late)
        .groupBy(F.window("_event", window).alias("window"), *map(column, keys))
        .agg(*[v.col.alias(n) for n, v in found.items()])
        .select(F.col("window.start").alias("window_start"), *map(column, keys), *map(column, found))
    )
