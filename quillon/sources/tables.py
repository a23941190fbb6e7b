"""Sources of relations: Parquet, CSV, sample data, and columns that make rows distinct."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.values import INT, STR, QueryError
from quillon.operators.relation import Relation
from quillon.operators.scopes import FRESH, column

#: The sample relations (fixed values).
SAMPLE = {
    "E": (
        "emp_id long, name string, salary long, dept_id long, role string",
        [
            (1, "Alice", 80000, 10, "engineer"),
            (2, "Bob", 60000, 10, "manager"),
            (3, "Carol", 55000, 20, "engineer"),
            (4, "Dave", 90000, 10, "engineer"),
            (5, "Eve", 45000, 20, "engineer"),
        ],
    ),
    "D": ("dept_id long, dept_name string", [(10, "Engineering"), (20, "Sales")]),
    "Phone": ("emp_id long, phone string", [(1, "555-1234"), (3, "555-5678"), (3, "555-9999")]),
    "ContractorPay": ("name string, pay long", [("Frank", 70000)]),
}


def parquet(spark: SparkSession, path: str, key: list[str] | None = None, trusted: bool = False) -> Relation:
    return Relation.bind(spark.read.parquet(path), key, trusted)


def sample(spark: SparkSession) -> dict[str, Relation]:
    return {n: Relation.bind(spark.createDataFrame(rows, schema), trusted=True) for n, (schema, rows) in SAMPLE.items()}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one in a local session without any."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise QueryError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = "file://" + made
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: RFC 4180: quotes are doubled inside quotes, a backslash is a character like any other.
DIALECT = {"quote": '"', "escape": '"', "mode": "DROPMALFORMED", "inferSchema": "false"}


def csv(spark: SparkSession, path: str, make: dict[str, str] | None = None, split: bool = False) -> Relation:
    """A CSV file, or a folder of them, each with a header. Rows of the wrong width are skipped,
    names are stripped, of columns with one name the last stays, empty cells are empty text, and a
    column is int, decimal or bool if all its cells are.

    split: no cell holds a line break, so that large files can be read in parts.
    make: columns to add, name to kind (``key``: 1, 2, ... in file order; ``uuid``; ``hash``).
    """
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")
    reader = spark.read.options(**DIALECT, multiLine=str(not split).lower())
    header = reader.csv(path).first()
    if header is None:
        return typed(spark.createDataFrame([], T.StructType([])), make)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(header))])
    return typed(headed(reader.schema(schema).option("header", True).csv(path), [n or "" for n in header]), make)


def headed(lines: DataFrame, header: list[str]) -> DataFrame:
    """The text columns under their names; of columns with one name the last stays."""
    place = {name.strip(): f"_{i}" for i, name in enumerate(header)}
    return lines.select(*[F.coalesce(at, F.lit("")).alias(name) for name, at in place.items()])


def typed(lines: DataFrame, make: dict[str, str] | None = None) -> Relation:
    """Text columns with their inferred types; one aggregation looks at all of them."""
    names = lines.columns
    if not names:
        return Relation(lines, distinct=True)
    tests = []
    for i, n in enumerate(names):
        c = column(n)
        whole = c.rlike(r"^\s*[-+]?\d+\s*$") & c.try_cast(INT).isNotNull()
        number = c.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)\s*$")
        scale = F.max(F.length(F.regexp_extract(c, r"\.(\d+)\s*$", 1)))
        before = F.max(F.length(F.regexp_extract(c, r"^\s*[-+]?0*(\d*)", 1)))
        flag = F.lower(c).isin("true", "false")
        tests += [
            F.coalesce(F.bool_and(whole), F.lit(False)).alias(f"w{i}"),
            F.coalesce(F.bool_and(number), F.lit(False)).alias(f"n{i}"),
            scale.alias(f"s{i}"),
            before.alias(f"d{i}"),
            F.coalesce(F.bool_and(flag), F.lit(False)).alias(f"b{i}"),
        ]
    facts = lines.agg(*tests).first()
    cols = []
    for i, n in enumerate(names):
        c = column(n)
        if facts[f"w{i}"]:
            c = F.trim(c).cast(INT)
        elif facts[f"n{i}"] and facts[f"s{i}"] <= 18 and facts[f"s{i}"] + facts[f"d{i}"] <= 38:
            # Numbers with more digits than a decimal holds stay text.
            c = F.trim(c).cast(T.DecimalType(38, facts[f"s{i}"]))
        elif facts[f"b{i}"]:
            c = F.lower(c) == "true"
        cols.append(c.alias(n))
    df = lines.select(*cols)
    keys, declared = [], {}
    for name, kind in (make or {}).items():
        df = _made(df, name, kind)
        declared[name] = "int" if kind == "key" else "str"
        if kind != "hash":
            keys.append(frozenset([name]))
    return Relation(df, keys=tuple(keys), declared=declared or None)


def _made(df: DataFrame, name: str, kind: str) -> DataFrame:
    if name in df.columns:
        raise QueryError(f"attribute {name!r} is there already")
    if kind in ("key", "uuid"):
        # The upper bits of the id are the partition, its lower 33 bits the row's place in it; the
        # same in each run over the same files.
        row = F.monotonically_increasing_id()
    if kind == "uuid":
        salt = uuid.uuid4().hex
        hex_ = F.md5(F.concat(F.lit(salt), row.cast(STR)).cast("binary"))
        part = lambda at, size: F.substring(hex_, at, size)
        parts = [part(1, 8), part(9, 4), F.concat(F.lit("4"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12)]
        return df.withColumn(name, F.concat_ws("-", *parts))
    if kind == "key":
        mark = f"_row{next(FRESH)}"
        df = df.withColumn(mark, row)
        before, starts = 0, {}
        counts = df.groupBy(F.shiftright(mark, 33).cast("int").alias("part")).count().collect()
        for found in sorted(counts, key=lambda r: r["part"]):
            starts[found["part"]] = before
            before += found["count"]
        lengths = [starts.get(k, 0) for k in range(max(starts, default=-1) + 1)] or [0]
        start = F.element_at(F.lit(lengths).cast("array<long>"), F.shiftright(mark, 33).cast("int") + 1)
        key = (start + column(mark).bitwiseAND((1 << 33) - 1) + 1).cast(INT)
        return df.select(key.alias(name), *[column(n) for n in df.columns if n != mark])
    if kind == "hash":
        parts = [F.concat(F.lit(n + "\0"), column(n).cast(STR)) for n in sorted(df.columns)]
        return df.withColumn(name, F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16))
    raise QueryError(f"unknown kind of column {kind!r}")
