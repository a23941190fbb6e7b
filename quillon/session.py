"""A session: named relations, type aliases and functions, and the text language over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.functions.expressions import Expr, Lit
from quillon.functions.values import INT, QueryError, spark_type
from quillon.lang.syntax import HOLE, Alias, Assign, Define, Rel, parse
from quillon.operators.relation import Relation
from quillon.operators.scopes import Scope

REFERENCE = re.compile(r"in\(\s*(\w+)\s*,\s*(\w+)\s*\)")


class Session:
    """``run`` takes statements of the language; ``bind`` takes DataFrames."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.relations: dict[str, Relation] = {}
        self.aliases: dict[str, str] = {}
        self.functions: dict[str, Define | Callable[[Relation], Relation]] = {}
        self._calls: list[str] = []

    # -- names

    def bind(
        self, name: str, df: DataFrame | Relation, key: Iterable[str] | None = None, trusted: bool = False
    ) -> Relation:
        found = df if isinstance(df, Relation) else Relation.bind(df, key, trusted)
        if found.ordered:
            raise QueryError("a sorted or ordered result cannot be named")
        found.session = self
        self.relations[name] = found
        return found

    def register(self, name: str, function: Callable[[Relation], Relation]) -> None:
        """A Python function from relation to relation, called like one of the language."""
        self.functions[name] = function

    def resolve_type(self, name: str) -> T.DataType:
        """The Spark type of a type name, through aliases and references."""
        target = self._target(name)
        if place := self.reference(target):
            relation, attr = place
            return relation.types[attr]
        return spark_type(target)

    def _target(self, name: str) -> str:
        seen = [name]
        while seen[-1] in self.aliases:
            if self.aliases[seen[-1]] in seen:
                raise QueryError(f"type {name} is defined by itself")
            seen.append(self.aliases[seen[-1]])
        return seen[-1]

    def reference(self, kind: str) -> tuple[Relation, str] | None:
        """The relation and attribute that a type ``in(R, a)`` refers to."""
        found = REFERENCE.fullmatch(self._target(kind))
        if not found:
            return None
        if found[1] not in self.relations:
            raise QueryError(f"unknown relation {found[1]!r}")
        relation = self.relations[found[1]]
        if found[2] not in relation.heading:
            raise QueryError(f"{found[1]} has no attribute {found[2]!r}")
        return relation, found[2]

    # -- statements

    def run(self, statement: str) -> Relation | None:
        """Evaluates one statement; definitions give None."""
        tree = parse(statement)
        if isinstance(tree, Assign):
            self.bind(tree.name, self.evaluate(tree.value))
            return None
        if isinstance(tree, Define):
            self.functions[tree.name] = tree
            return None
        if isinstance(tree, Alias):
            before = dict(self.aliases)
            self.aliases[tree.name] = tree.target
            try:
                self.resolve_type(tree.name)
            except QueryError:
                self.aliases = before
                raise
            return None
        return self.evaluate(tree)

    def relation(self, tree: Rel) -> Relation:
        found = self.evaluate(tree)
        if found.ordered:
            raise QueryError("a sorted or ordered result is no relation")
        return found

    def evaluate(self, tree: Rel, hole: Relation | None = None) -> Relation:
        """A tree as a lazy relation. hole: what a function is applied to."""
        chain = []
        while tree.source is not None:
            chain.append(tree)
            tree = tree.source
        out = hole if tree is HOLE else self._start(tree)
        for node in reversed(chain):
            out = self._step(out, node)
            out.session = self
        return out

    def _start(self, tree: Rel) -> Relation:
        args = tree.args
        if tree.op == "name":
            if args["name"] not in self.relations:
                raise QueryError(f"unknown relation {args['name']!r}")
            return self.relations[args["name"]]
        if tree.op == "iota":
            count = self.constant(args["count"])
            if isinstance(count, bool) or not isinstance(count, int) or count < 1:
                raise QueryError(f"a range needs a positive number of rows, not {count!r}")
            first = 0 if args["zero"] else 1
            df = self.spark.range(first, first + count).toDF(args["name"])
            return Relation(df, keys=(frozenset([args["name"]]),), declared={args["name"]: "int"}, session=self)
        if tree.op == "literal":
            return self.literal(args["heading"], [[self.constant(x) for x in row] for row in args["rows"]])
        raise QueryError(f"unknown source {tree.op}")

    def constant(self, expr: Expr):
        """The value of an expression without attributes. Only subqueries run anything."""
        if isinstance(expr, Lit):
            return expr.raw
        empty = Relation(self.spark.range(1).select(), distinct=True, session=self)
        v = expr.value(Scope(empty, self))
        return self.spark.range(1).select(v.col.alias("v")).first()["v"]

    def literal(self, heading: list[str], rows: list[list]) -> Relation:
        if len(set(heading)) < len(heading):
            raise QueryError("two attributes have one name")
        kinds = []
        for i in range(len(heading)):
            column = [r[i] for r in rows]
            whole = all(isinstance(x, int) and not isinstance(x, bool) for x in column)
            number = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in column)
            flags = all(isinstance(x, bool) for x in column)
            kinds.append(
                T.StringType() if not rows else INT if whole else T.DoubleType() if number else T.BooleanType() if flags else T.StringType()
            )
        made = [
            tuple(float(x) if isinstance(k, T.DoubleType) else str(x) if isinstance(k, T.StringType) else x for x, k in zip(r, kinds, strict=True))
            for r in rows
        ]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(heading, kinds, strict=True)])
        # As an Arrow table, so that the planner knows its size. A list becomes an RDD, which counts
        # as larger than any table: joins then sort the other side, a key's rows in one task.
        columns = list(zip(*dict.fromkeys(made), strict=True)) or [()] * len(heading)
        try:
            arrow = [pa.array(c, to_arrow_type(k)) for c, k in zip(columns, kinds, strict=True)]
        except OverflowError as problem:
            raise QueryError("a whole number of a literal has more than 64 bits") from problem
        return Relation(self.spark.createDataFrame(pa.table(arrow, names=heading), schema), distinct=True, session=self)

    def _step(self, left: Relation, node: Rel) -> Relation:
        args = dict(node.args)
        if node.op == "call":
            return self._call(left, args["name"])
        if "other" in args:
            args["other"] = self.relation(args["other"])
        method = getattr(left, node.op)
        if node.op in ("where", "where_not"):
            return method(args["test"])
        if node.op == "nest_join":
            return method(args["name"], args["other"])
        if node.op == "left_join":
            return method(args["other"], args["defaults"])
        if node.op == "apply_schema":
            return method(args["other"])
        if node.op == "split":
            return method(args["column"], args["pattern"], args["new"])
        return method(**args)

    def _call(self, left: Relation, name: str) -> Relation:
        if left.ordered:
            raise QueryError("a function takes a relation")
        if name not in self.functions:
            raise QueryError(f"unknown function {name!r}")
        if name in self._calls:
            raise QueryError(f"function {name} calls itself")
        self._calls.append(name)
        try:
            function = self.functions[name]
            return self.evaluate(function.chain, left) if isinstance(function, Define) else function(left)
        finally:
            self._calls.pop()


