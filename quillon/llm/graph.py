"""Connected components of a link table, without leaving DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut

#: Links up to which one task joins them: some 200 MB of its memory. More are joined in rounds.
AT_ONCE = 1_000_000


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """node, comp: the smallest node that links (columns a, b) reach, for every node that has one.

    The links are counted first. A number that one task can hold goes to one; beyond it two kinds
    of star alternate until nothing moves: each node hands its smallest neighbour to the larger
    ones, then to the smaller ones, in rounds that grow with the logarithm of the number of nodes.
    No links give no rows.
    """
    now = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= at_once:
        return cut(now.coalesce(1).mapInArrow(_united, "node long, comp long"), "components")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("comp", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find; the root of a tree is its smallest node."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    for at in range(0, len(nodes), 50_000):
        some = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "comp"]
        )
