"""Exact dedup: composable polynomial fingerprints, then a chunkwise byte comparison.

A text's identity is its UTF-8 form without ASCII white space. Chunks of it are hashed apart
from each other and combine by length-shifted arithmetic, ``H(xy) = H(x) * B**len(y) + H(y)``,
so a huge text's chunks may be hashed anywhere and in any order. Texts with equal fingerprint
and length are candidates; candidates are compared chunk by chunk as a stream sorted by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, filter_bits, filter_size, passes, pick, small_batches

WHITE = b" \t\n\r\x0b\x0c"
CHUNK = 1 << 16
#: Two Mersenne-prime moduli; sums of a chunk's terms stay below 2**64.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 69_069_911)
#: Candidates of one key that one task compares at a time.
SALT_ROWS = 1000


def _powers(base: int) -> np.ndarray:
    """base**(CHUNK-1) ... base**0 modulo PRIME."""
    out = np.ones(1, np.uint64)
    while len(out) < CHUNK:
        step = np.uint64(pow(base, len(out), PRIME))
        out = np.concatenate([out * step % np.uint64(PRIME), out])
    return out[-CHUNK:]


POWERS = tuple(_powers(b) for b in BASES)


def chunk_hashes(data: bytes) -> list[tuple[int, int, int]]:
    """(length, hash, hash) of each chunk; every chunk by itself."""
    out = []
    for at in range(0, len(data), CHUNK):
        part = np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at).astype(np.uint64) + np.uint64(1)
        n = len(part)
        out.append((n, *(int(np.dot(part, p[CHUNK - n :])) % PRIME for p in POWERS)))
    return out


def combine(parts: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The fingerprint of parts put one after another; associative."""
    length, a, b = 0, 0, 0
    for n, x, y in parts:
        a = (a * pow(BASES[0], n, PRIME) + x) % PRIME
        b = (b * pow(BASES[1], n, PRIME) + y) % PRIME
        length += n
    return length, a, b


def fingerprint(data: bytes) -> tuple[int, int]:
    """(length, 62-bit fingerprint)."""
    length, a, b = combine(chunk_hashes(data))
    return length, a << 31 | b


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison; stops at the first chunk that differs."""
    x, y = memoryview(a), memoryview(b)
    return len(x) == len(y) and all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(x), CHUNK))


def _fingerprints(wanted=None, size: int = 0):
    """Rows with the fingerprint and the text's digest. wanted: a broadcast filter of so many bits;
    then only rows whose fingerprint passes it, with the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            norms = [normal(x) for x in texts]
            marks = [fingerprint(x) for x in norms]
            if wanted is not None:
                slots = np.array([m[1] & size - 1 for m in marks], np.int64)
                keep = np.flatnonzero(passes(wanted.value, slots)).tolist()
                batch = batch.take(pa.array(keep, pa.int64()))
                texts, norms, marks = ([x[k] for k in keep] for x in (texts, norms, marks))
            cols = [
                batch.column(0),
                pa.array([len(x or "") for x in texts], pa.int64()),
                pa.array([m[0] for m in marks], pa.int64()),
                pa.array([m[1] for m in marks], pa.int64()),
            ]
            names = ["doc_id", "n_chars", "n_bytes", "mark"]
            if wanted is not None:
                cols.append(pa.array(norms, pa.binary()))
                names.append("norm")
            else:
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in norms]))
                names.append("text_sha256")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mark, n_bytes, salt): the number of the equal text among those of its key.

    Holds one key's different texts; that is one, but for colliding fingerprints.
    """
    key, firsts = None, []
    for batch in batches:
        numbers, texts = [], []
        marks, sizes, salts = (batch.column(i).to_pylist() for i in range(3))
        for at, own in enumerate(zip(marks, sizes, salts, strict=True)):
            text = batch.column(6)[at].as_buffer().to_pybytes()
            if own != key:
                key, firsts = own, []
            number = next((i for i, x in enumerate(firsts) if same(x, text)), len(firsts))
            texts.append(text if number == len(firsts) else None)
            if number == len(firsts):
                firsts.append(text)
            numbers.append(number)
        keep = [batch.column(i) for i in range(6)]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(numbers, pa.int64()), pa.array(texts, pa.binary())],
            ["mark", "n_bytes", "salt", "doc_id", "n_chars", "salts", "number", "first"],
        )


COMPARED = "mark long, n_bytes long, salt long, doc_id long, n_chars long, salts long, number long, first binary"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and white-space-only texts equal the empty text. Of equal texts the row with the most
    code points stays, then the smallest id (a null id only if there is no other). Rows that
    repeat an id stay rows; with equal text too, each has the same keep_id and counts as kept
    if its id is keep_id. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = cut(
        docs.mapInArrow(
            _fingerprints(), "doc_id long, n_chars long, n_bytes long, mark long, text_sha256 string"
        ),
        "exact-marks",
    )
    keys = (
        marks.groupBy("mark", "n_bytes")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("long"))
        .drop("n")
    )
    keys = cut(keys, "exact-keys")
    size = filter_size(keys.count())
    slots = keys.select(F.expr(f"CAST(mark & {size - 1} AS INT)").alias("slot"))
    wanted = docs.sparkSession.sparkContext.broadcast(filter_bits(slots, size))
    # Only texts whose fingerprint may repeat are moved.
    rows = docs.mapInArrow(
        _fingerprints(wanted, size), "doc_id long, n_chars long, n_bytes long, mark long, norm binary"
    ).join(keys, ["mark", "n_bytes"])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    order = ["mark", "n_bytes", "salt"]
    compared = (
        rows.select(*order, "doc_id", "n_chars", "salts", "norm")
        .repartition(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_compare, COMPARED)
    )
    compared = cut(compared.withColumn("first", F.when(F.col("salts") > 1, F.col("first"))), "exact-compared")
    # The different texts of each salt meet their likes of the other salts of the key.
    firsts = (
        compared.where("first IS NOT NULL")
        .select("mark", "n_bytes", F.lit(0).cast("long").alias("salt"), F.col("salt").alias("doc_id"),
                F.col("number").alias("n_chars"), "salts", "first")
        .repartition("mark", "n_bytes")
        .sortWithinPartitions("mark", "n_bytes")
        .mapInArrow(_compare, COMPARED)
        .select("mark", "n_bytes", F.col("doc_id").alias("salt"), F.col("n_chars").alias("number"),
                F.col("number").alias("text_no"))
    )
    numbered = compared.drop("first").join(firsts, ["mark", "n_bytes", "salt", "number"], "left")
    numbered = numbered.withColumn("text_no", F.coalesce("text_no", "number"))
    first = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id")))
    kept = numbered.groupBy("mark", "n_bytes", "text_no").agg(
        first.alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    # Only a colliding key has more than one text; elsewhere the key alone finds the group.
    group_of = numbered.select("mark", "n_bytes", "doc_id", "n_chars", "text_no").where("text_no > 0").distinct()
    labelled = marks.join(group_of, ["mark", "n_bytes", "doc_id", "n_chars"], "left").withColumn(
        "text_no", F.coalesce("text_no", F.lit(0).cast("long"))
    )
    out = labelled.join(kept, ["mark", "n_bytes", "text_no"], "left")
    keep_id = F.when(F.col("best").isNotNull(), F.col("best.doc_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
