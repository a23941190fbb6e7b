"""A corpus pipeline over ``documents``: toxicity, line dedup, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard_join, line_dedup, mixing, sentencepiece_bpe, toxicity
from quillon.llm.common import cut, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity operator rejects, each row by its own text. Null and
    empty texts, null and repeated ids, and an empty table need no care."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With repeated runs of lines removed; documents of which nothing is left go. Blank and null
    texts stay; rows that repeat both id and text are one document; an empty table stays empty."""
    return line_dedup.rewrite(docs, runs=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group.

    Texts without words are near nothing and stay, as do rows with a null id. Rows that share an
    id are one document: they go together if any of them is in a group with a smaller id.
    """
    dropped = jaccard_join.jaccard_join(docs).where("component_id != doc_id").select("doc_id").distinct()
    wide, own = _numbered(docs)
    return _named(wide.join(dropped, F.col(own) == F.col("doc_id"), "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; rows that share an id, null among them, as
    often as the one of them that it takes most."""
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").alias("copies"))
    wide, own = _numbered(docs)
    taken = wide.join(copies.where("copies > 0"), F.col(own).eqNullSafe(F.col("of")))
    return _named(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row; null texts are empty, null ids stay null."""
    return sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The columns as c0, c1, ..., as names may clash, and which of them is doc_id."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('doc_id')}"


def _named(wide: DataFrame, docs: DataFrame) -> DataFrame:
    return wide.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode),
]

#: Models, hashes and tokenizers are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages, one after the other, make of documents."""
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs, "pipeline")
    return docs
