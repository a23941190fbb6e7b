"""What expressions see: a row of a relation, or a group of rows."""

from __future__ import annotations

import itertools
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.expressions import Agg, Expr, nested_aggregate
from quillon.functions.values import (
    FLOAT,
    INT,
    STR,
    WIDE,
    QueryError,
    Value,
    is_nested,
    is_number,
    number,
    spark_type,
    type_name,
)

if TYPE_CHECKING:
    from quillon.operators.relation import Relation

FRESH = itertools.count()


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Scope:
    """Attributes of a relation, and the relations and types that a session names."""

    def __init__(self, relation: Relation, session=None):
        self.relation, self.session = relation, session
        self.types = relation.types
        #: Joins that membership tests need: (distinct members, key, flag).
        self.flags: list[tuple[DataFrame, Column, str]] = []

    # -- names

    def has(self, name: str) -> bool:
        return name in self.types

    def is_relation(self, name: str) -> bool:
        return self.session is not None and name in self.session.relations

    def named(self, name: str):
        from quillon.lang.syntax import Rel

        return Rel("name", None, {"name": name})

    def attribute(self, name: str) -> Value:
        if name not in self.types:
            if self.is_relation(name):
                return self.scalar(self.named(name))
            raise QueryError(f"unknown attribute {name!r} (have: {', '.join(sorted(self.types))})")
        return Value(column(name), self.types[name])

    def resolve_type(self, name: str) -> T.DataType:
        return self.session.resolve_type(name) if self.session else spark_type(name)

    def evaluate(self, tree: Any) -> Relation:
        if self.session is None:
            raise QueryError("a subquery needs a session")
        return self.session.relation(tree)

    # -- subqueries

    def scalar(self, tree: Any) -> Value:
        """The one value of a relation of one row; any other number of rows is an error."""
        found = self.evaluate(tree)
        if len(found.heading) != 1:
            raise QueryError("a subquery used as a value must have one attribute")
        (name, kind), = found.types.items()
        rows = found.as_set().df
        one = F.count(F.lit(1)) == 1
        guard = F.when(one, F.first(column(name))).otherwise(
            F.raise_error(F.lit("a subquery used as a value must have one row")).cast(kind)
        )
        return Value(rows.agg(guard.alias("v")).scalar(), kind)

    def member(self, v: Value, tree: Any, loose: bool = False) -> Column:
        """Whether a value is in a relation of one attribute: an equality join with its distinct
        values sets a flag. loose: as a filter compares, where text that reads as numbers meets as
        numbers on both sides."""
        found = self.evaluate(tree)
        if len(found.heading) != 1:
            raise QueryError("membership needs a relation of one attribute")
        (name, kind), = found.types.items()
        a, b = meeting(v, Value(column(name), kind), loose)
        own = f"_member{next(FRESH)}"
        right = found.df.select(b.col.alias(own)).where(column(own).isNotNull()).distinct()
        flag = f"_flag{next(FRESH)}"
        self.flags.append((right.withColumn(flag, F.lit(True)), a.col.alias(own), flag))
        return column(flag).isNotNull()

    def flagged(self, df: DataFrame) -> DataFrame:
        """The rows with the flags that membership tests have asked for."""
        for right, key, flag in self.flags:
            probe = f"_probe{next(FRESH)}"
            own = right.columns[0]
            df = df.withColumn(probe, key).join(right, column(probe) == column(own), "left").drop(probe, own)
        return df

    # -- aggregates in a row

    def aggregate(self, agg: Agg) -> Value:
        """Of a nested relation of this row, or of a named relation, once for all rows."""
        tree = agg.relation or (self.named(agg.name) if agg.name else None)
        if agg.op == "pct":
            raise QueryError("p. in a row needs a source to be a share of")
        if tree is None:
            raise QueryError(f"an aggregate in a row needs a relation: {agg.op}")
        base, steps = tree, []
        while base.source is not None:
            steps.append(base)
            base = base.source
        name = base.args.get("name") if base.op == "name" else None
        if name in self.types and is_nested(self.types[name]):
            v = self._nested(self.attribute(name), steps[::-1])
            return nested_aggregate(agg.op, v, agg.attr)
        if name in self.types:
            raise QueryError(f"{name} is {type_name(self.types[name])}, not a relation")
        found = self.evaluate(tree)
        scope = GroupScope(found, self.session)
        v = scope.aggregate(Agg(agg.op, agg.attr, None, None))
        row = found.as_set().df.agg(v.col.alias("v"))
        return Value(row.scalar(), v.type)

    def _inner_test(self, fields: dict, condition: Expr, keep: bool):
        def test(x: Column) -> Column:
            found = condition.test(_Inner(fields, x, self))
            return found if keep else ~found

        return test

    def _nested(self, v: Value, steps: list) -> Value:
        """A nested relation after filters and projections."""
        for step in steps:
            fields = {f.name: f.dataType for f in v.type.elementType.fields}
            if step.op in ("where", "where_not"):
                keep = step.op == "where"

                v = Value(F.filter(v.col, self._inner_test(fields, step.args["test"], keep)), v.type)
            elif step.op == "project":
                names = sorted(step.args["names"])
                if missing := [n for n in names if n not in fields]:
                    raise QueryError(f"unknown attributes {missing} of the nested relation")
                kind = T.ArrayType(T.StructType([T.StructField(n, fields[n]) for n in names]), False)
                v = Value(F.array_sort(F.array_distinct(F.transform(v.col, _fields(names)))), kind)
            else:
                raise QueryError("a nested relation takes filters and projections here")
        return v


def _fields(names: list[str]):
    return lambda x: F.struct(*[x[n].alias(n) for n in names])


class _Inner(Scope):
    """Attributes of one row of a nested relation; other names are those of the row around it."""

    def __init__(self, fields: dict, row: Column, outer: Scope):
        self.fields, self.row, self.around = fields, row, outer
        self.types = fields
        self.session = outer.session
        self.flags = outer.flags

    def attribute(self, name: str) -> Value:
        if name in self.fields:
            return Value(self.row[name], self.fields[name])
        return self.around.attribute(name)


def meeting(a: Value, b: Value, loose: bool = False) -> tuple[Value, Value]:
    """Two values brought to one type for an equality: text meets dates and numbers as those."""
    if isinstance(a.type, T.StringType) != isinstance(b.type, T.StringType):
        other = b if isinstance(a.type, T.StringType) else a
        if isinstance(other.type, T.DateType):
            kind, read = T.DateType(), lambda v: F.try_to_date(v.col)
        elif is_number(other.type):
            kind, read = WIDE, lambda v: v.col.try_cast(WIDE)
        else:
            return Value(a.col.cast(STR), STR), Value(b.col.cast(STR), STR)
        return tuple(Value(read(v) if isinstance(v.type, T.StringType) else v.col.cast(kind), kind) for v in (a, b))
    if loose and isinstance(a.type, T.StringType):
        shown = lambda v: F.coalesce(v.col.try_cast(WIDE).cast(STR), v.col)
        return Value(shown(a), STR), Value(shown(b), STR)
    if is_number(a.type) and is_number(b.type) and a.type != b.type:
        kind = FLOAT if FLOAT in (a.type, b.type) else WIDE
        return Value(a.col.cast(kind), kind), Value(b.col.cast(kind), kind)
    return a, b


class GroupScope(Scope):
    """Aggregate expressions over the rows of a group."""

    def __init__(self, relation: Relation, session=None, totals: dict[str, Column] | None = None):
        super().__init__(relation, session)
        #: Sums over the whole relation, for percentages: attribute -> column.
        self.totals = totals
        #: Attributes whose whole sums percentages need.
        self.shares: set[str] = set()

    def attribute(self, name: str) -> Value:
        if self.is_relation(name) and name not in self.types:
            return self.scalar(self.named(name))
        raise QueryError(f"{name!r} stands outside an aggregate")

    def aggregate(self, agg: Agg) -> Value:
        if agg.relation is not None or agg.attr is not None:
            return super().aggregate(agg)
        if agg.op == "count":
            return Value(F.count(F.lit(1)), INT)
        if agg.op == "collect" and agg.name is None:
            return collected(self.types)
        if agg.name is None:
            raise QueryError(f"{agg.op} needs an attribute")
        v = super().attribute(agg.name)
        if agg.op == "collect":
            return collected({agg.name: v.type})
        if agg.op in ("max", "min"):
            most, by = (F.max, F.max_by) if agg.op == "max" else (F.min, F.min_by)
            found = most(v.col)
            if isinstance(v.type, T.StringType):
                # Text that is all numbers is compared as numbers.
                as_number = v.col.try_cast(WIDE)
                found = F.when(F.bool_and(as_number.isNotNull()), by(v.col, F.struct(as_number, v.col))).otherwise(found)
            return Value(_present(found, v.type, agg.op), v.type)
        v = number(v, agg.op)
        if agg.op == "sum":
            zero = F.lit(0).cast(v.type)
            return Value(F.coalesce(F.sum(v.col).cast(v.type), zero), v.type)
        if agg.op == "mean":
            if isinstance(v.type, T.DecimalType):
                return Value(_present(F.avg(v.col.cast(T.DecimalType(34, min(v.type.scale, 14)))).cast(WIDE), WIDE, "mean"), WIDE)
            return Value(_present(F.avg(v.col), FLOAT, "mean"), FLOAT)
        if agg.op == "pct":
            self.shares.add(agg.name)
            whole = self.totals[agg.name] if self.totals else F.sum(v.col)
            bad = F.raise_error(F.lit("percent of a total of zero")).cast("double")
            share = F.sum(v.col).cast(FLOAT) / F.when(whole != 0, whole.cast(FLOAT)).otherwise(bad) * 100
            return Value(share, FLOAT)
        raise QueryError(f"unknown aggregate {agg.op}")


def _present(col: Column, kind: T.DataType, what: str) -> Column:
    """The aggregate of no rows is an error, not a null."""
    return F.coalesce(col, F.raise_error(F.lit(f"{what} of no rows")).cast(kind))


def canonical(names: list[str]) -> Column:
    """Rows as the sorted distinct structs of a nested relation."""
    return F.array_sort(F.collect_set(F.struct(*[column(n).alias(n) for n in sorted(names)])))


def nested_type(types: dict[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, types[n]) for n in sorted(types)]), False)


def collected(types: dict[str, T.DataType]) -> Value:
    return Value(canonical(list(types)), nested_type(types))


def values(named: list[tuple[str, Expr]], scope: Scope) -> dict[str, Value]:
    return {name: expr.value(scope) for name, expr in named}

