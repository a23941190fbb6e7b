"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of vectors; every vector is then routed to its leaf. A
query walks the tree with a priority queue over the branches not taken, nearest centre first, and
visits as many leaves as the sample needed to reach the calibrated recall, more if those hold too
few vectors. Visited leaves are searched in full, with the measure on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, pick

#: Vectors of the sample, vectors wanted in a leaf, leaves at least, and vectors of the sample for
#: each leaf. So leaves grow with the rows up to SAMPLE / EACH of them; beyond that they get larger.
SAMPLE, LEAF, FEWEST, EACH = 40_000, 512, 8, 8
BRANCH, ROUNDS = 8, 12
#: Recall on the sample at which widening stops; queries that measure it.
RECALL, PROBES = 0.97, 400
#: Rows of a leaf that one task searches.
BLOCK = 20_000


@dataclass
class Tree:
    """Nodes with unit centres; a node without children is a leaf with a number."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    visits: int = 1

    @property
    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def route(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: nearest centre, level by level."""
        out = np.zeros(len(unit), np.int64)
        open_ = [(0, np.arange(len(unit)))]
        while open_:
            node, rows = open_.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            nearest = np.argmax(unit[rows] @ self.centres[below].T, axis=1)
            open_ += [(b, rows[nearest == k]) for k, b in enumerate(below) if (nearest == k).any()]
        return out

    def visit(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves of one query, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while below := self.children[node]:
                first, *rest = sorted(zip((-(self.centres[below] @ unit)).tolist(), below, strict=True))
                for branch in rest:
                    heapq.heappush(queue, branch)
                node = first[1]
            yield self.leaf[node]


def _split(unit: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre) of spherical k-means, started from far apart rows."""
    centres = unit[[rng.integers(len(unit))]]
    far = 1 - unit @ centres[0]
    for _ in range(k - 1):
        weight = np.maximum(far, 0) ** 2
        if weight.sum() <= 1e-12:
            break
        centres = np.r_[centres, unit[[rng.choice(len(unit), p=weight / weight.sum())]]]
        far = np.minimum(far, 1 - unit @ centres[-1])
    for _ in range(ROUNDS):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres, np.argmax(unit @ centres.T, axis=1)


def fit(sample: np.ndarray, leaves: int, neighbours: int = 5, recall: float = RECALL, seed: int = 5) -> Tree:
    """A tree of about so many leaves, with the number of visits that reaches the recall."""
    rng = np.random.default_rng(seed)
    unit = np.unique(_unit(sample).astype(np.float32), axis=0).astype(float)
    tree = Tree(np.zeros((1, sample.shape[1])), [[]], [-1])
    least = max(1, len(unit) // max(leaves, 1))
    open_ = [(0, np.arange(len(unit)))]
    centres = [tree.centres[0]]
    number = 0
    while open_:
        node, rows = open_.pop(0)
        groups: list[np.ndarray] = []
        if leaves > 1 and len(rows) > 1.5 * least and len(rows) > 1:
            k = int(min(BRANCH, max(2, round(len(rows) / least))))
            found, nearest = _split(unit[rows], k, rng)
            groups = [rows[nearest == c] for c in range(len(found))]
            found = [c for c, g in zip(found, groups, strict=True) if len(g)]
            groups = [g for g in groups if len(g)]
        if len(groups) < 2:
            tree.leaf[node] = number
            number += 1
            continue
        for centre, group in zip(found, groups, strict=True):
            tree.children[node].append(len(centres))
            open_.append((len(centres), group))
            centres.append(centre)
            tree.children.append([])
            tree.leaf.append(-1)
    tree.centres = np.array(centres)
    tree.visits = _calibrate(tree, unit, neighbours, recall, rng)
    return tree


def _calibrate(tree: Tree, unit: np.ndarray, neighbours: int, recall: float, rng: np.random.Generator) -> int:
    """Leaf visits that find this share of the sample's true neighbours."""
    if tree.leaves == 1:
        return 1
    own = tree.route(unit)
    probes = rng.permutation(len(unit))[:PROBES]
    at = []
    for p in probes:
        near = unit @ unit[p]
        near[p] = -2
        true = np.argpartition(-near, min(neighbours, len(unit) - 1) - 1)[:neighbours]
        turn = {leaf: i for i, leaf in enumerate(tree.visit(unit[p]))}
        at += [turn[own[t]] for t in true if t != p]
    return int(np.quantile(at, recall, method="higher")) + 1 if at else tree.leaves


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, width: int) -> np.ndarray:
    """The vectors, each times a power of two that brings its largest component to between 1/2 and 1.

    That changes no cosine and rounds nothing, and squares neither overflow nor vanish.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _routed(tree: Tree, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.route(_unit(_matrix(batch.column(1), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "x", "leaf"])

    return run


def _visits(tree: Tree, width: int, filled: dict[int, int], wanted: int):
    """Rows (query_id, x, leaf) of the leaves a query visits; wanted: vectors they must hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, leaves = [], []
            for i, unit in enumerate(_unit(_matrix(batch.column(1), width))):
                held = turns = 0
                for leaf in tree.visit(unit):
                    if turns >= tree.visits and held >= wanted:
                        break
                    turns += 1
                    held += filled.get(leaf, 0)
                    if leaf in filled:
                        take.append(i)
                        leaves.append(leaf)
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaves, pa.int64())], ["query_id", "x", "leaf"])

    return run


def _searched(width: int, neighbours: int):
    """The nearest of a block for each of its queries, on the original vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "mark": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids = right["vec_id"].to_numpy()
            x = _matrix(right["x"], width)
            norm = np.sqrt((x * x).sum(1))
            queries, own, marks = _matrix(left["x"], width), left["query_id"].to_numpy(), left["mark"].to_numpy()
            for q, me, mark in zip(queries, own, marks, strict=True):
                rough = (x @ q) / norm
                rough[ids == me] = -np.inf
                keep = min(neighbours, len(ids))
                floor = np.partition(rough, len(ids) - keep)[len(ids) - keep]
                # Rows within rounding of the last place are measured row by row.
                near = np.flatnonzero((rough >= floor - 1e-9 * (abs(floor) + 1)) & (ids != me))
                score = (x[near] * q).sum(1) / (norm[near] * np.sqrt((q * q).sum()))
                best = np.lexsort((ids[near], -score))[:keep]
                out["query_id"] += [me] * len(best)
                out["mark"] += [mark] * len(best)
                out["vec_id"] += ids[near][best].tolist()
                out["score"] += score[best].tolist()
        return pa.table(
            [pa.array(out[k], t) for k, t in (("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))],
            names=list(out),
        )

    return run


def nearest(
    vectors: DataFrame,
    every: int = 50,
    neighbours: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found by cosine, in double precision.

    Queries are the rows whose id is divisible by every; candidates all rows with another id.
    Ties go to the smaller vec_id. Rows with a null id, or a vector that is null, zero, or holds
    null or non-finite values, take no part; nor do vectors whose length is not the most frequent
    one. Equal rows are one query; rows that share an id with other vectors are queries of their
    own. Every table is searched through the tree. No usable rows give no rows.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, id_col, vector_col).toDF("vec_id", "x")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<double>").alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND x IS NOT NULL").where(~odd).where(F.exists("x", lambda v: v != 0))
    widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], empty)
    width, total = widths[0]["w"], widths[0]["count"]
    rows = rows.where(F.size("x") == width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()
    sample = _matrix(sample["x"], width)
    leaves = max(FEWEST, min(total // LEAF, len(sample) // EACH))
    tree = fit(sample, leaves, neighbours, recall)

    index = cut(rows.mapInArrow(_routed(tree, width), "vec_id long, x array<double>, leaf long"), "ann-index")
    filled = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.element_at(
        F.create_map(*[F.lit(v) for leaf, n in sorted(filled.items()) for v in (leaf, -(-n // BLOCK))]), F.col("leaf")
    )
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "x").distinct()
    asked = queries.mapInArrow(
        _visits(tree, width, filled, neighbours + 1), "query_id long, x array<double>, leaf long"
    ).withColumn("mark", F.xxhash64("x"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    held = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    found = (
        asked.withColumn("block", F.col("block").cast("int"))
        .groupBy("leaf", "block")
        .cogroup(held.groupBy("leaf", "block"))
        .applyInArrow(_searched(width, neighbours), "query_id long, mark long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")
