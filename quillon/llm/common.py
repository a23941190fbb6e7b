"""What the operators of this subpackage share: column choice, table cuts, batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import shared_dir

#: Rows of one Arrow batch sent to a Python worker; with texts this bounds a batch to a few MB.
BATCH_ROWS = 512
#: For tables in a folder of ``file:``, where Hadoop without its native library starts several chmod
#: processes for each file and for its checksum file. Until it runs its program such a process shares
#: all of the executor's memory, which counts twice meanwhile. Checksums are in the Parquet pages.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
WRITTEN = PLAIN_FILES | {"compression": "zstd", "parquet.page.write-checksum.enabled": "true"}
READ = {"parquet.page.verify-checksum.enabled": "true"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns; others go, even those whose names differ only in case."""
    places = [df.columns.index(name) for name in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(name) for i, name in zip(places, names, strict=True)])


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a table in the shared folder and read again.

    Lineage ends here: a lost executor costs no recomputation of what came before, and rows
    used twice are made once. All tables of an application lie in one folder, which can go when
    its results have been written. Pages whose bytes changed fail the read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**WRITTEN).parquet(path)
    return spark.read.options(**READ).schema(df.schema).parquet(path)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


#: Bits of a filter by hash: a power of two of eight or more for each row wanted, within 128 KB and
#: 16 MB. Beyond that more rows set more bits and let more through, never less.
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 27


def filter_size(wanted: int) -> int:
    """The bits of a filter for so many rows."""
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (8 * wanted).bit_length()))


def filter_bits(slots: DataFrame, size: int) -> bytes:
    """So many bits, those named in the one column (int) set."""
    name = slots.columns[0]
    words = (
        slots.groupBy(F.shiftright(name, 5).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {name} & 31))").alias("bits")).toArrow()
    )
    out = np.zeros(size // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.tobytes()


def passes(bits: bytes, slots: np.ndarray) -> np.ndarray:
    """Which slots have their bit set."""
    return np.frombuffer(bits, np.uint32)[slots >> 5] >> (slots & 31).astype(np.uint32) & 1 > 0
