"""Scalar expressions and conditions.

A tree is built by the parser and compiled against a scope, which knows the attributes and the
relations around it. Nothing runs until the relation it becomes part of is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import patterns
from quillon.functions.values import (
    FLOAT,
    STR,
    QueryError,
    Value,
    arithmetic,
    common,
    compare,
    is_nested,
    is_number,
    literal,
    number,
    strict,
    text,
    type_name,
)

if TYPE_CHECKING:
    from quillon.operators.scopes import Scope


class Expr:
    """A node; ``value`` gives its typed column."""

    def value(self, scope: Scope) -> Value:
        raise NotImplementedError

    def test(self, scope: Scope) -> Column:
        """The node as a condition."""
        raise QueryError(f"{type(self).__name__} is not a condition")


@dataclass(frozen=True)
class Lit(Expr):
    raw: Any

    def value(self, scope: Scope) -> Value:
        return literal(self.raw)


@dataclass(frozen=True)
class Attr(Expr):
    name: str

    def value(self, scope: Scope) -> Value:
        return scope.attribute(self.name)


@dataclass(frozen=True)
class Arith(Expr):
    op: str
    left: Expr
    right: Expr

    def value(self, scope: Scope) -> Value:
        return arithmetic(self.op, self.left.value(scope), self.right.value(scope))


@dataclass(frozen=True)
class Round(Expr):
    inner: Expr
    places: int

    def value(self, scope: Scope) -> Value:
        v = number(self.inner.value(scope), "~")
        kind = T.DecimalType(38, self.places)
        return Value(F.bround(v.col.cast(FLOAT), self.places).cast(kind), kind)


@dataclass(frozen=True)
class Slice(Expr):
    inner: Expr
    start: int
    end: int | None

    def value(self, scope: Scope) -> Value:
        return patterns.cut(self.inner.value(scope), self.start, self.end)


@dataclass(frozen=True)
class Keyword(Expr):
    inner: Expr
    word: str

    def value(self, scope: Scope) -> Value:
        return patterns.keyword(self.inner.value(scope), self.word)


@dataclass(frozen=True)
class Replace(Expr):
    inner: Expr
    pattern: str
    replacement: str

    def value(self, scope: Scope) -> Value:
        s = text(self.inner.value(scope))
        new = F.lit(patterns.java_replacement(self.replacement))
        return Value(F.regexp_replace(s, F.lit(patterns.java(self.pattern)), new), STR)


@dataclass(frozen=True)
class Date(Expr):
    inner: Expr
    word: str | None

    def value(self, scope: Scope) -> Value:
        return patterns.date_part(self.inner.value(scope), self.word)


@dataclass(frozen=True)
class Format(Expr):
    """Text with {attribute} or {attribute:format} in it."""

    template: str

    def value(self, scope: Scope) -> Value:
        pieces = []
        for i, piece in enumerate(re.split(r"\{([^}]+)\}", self.template)):
            if i % 2 == 0:
                pieces.append(F.lit(piece))
                continue
            name, _, spec = piece.partition(":")
            v = scope.attribute(name.strip())
            pieces.append(patterns.formatted(v, spec) if spec else text(v))
        return Value(F.concat(*pieces), STR)


@dataclass(frozen=True)
class Cast(Expr):
    inner: Expr
    target: str

    def value(self, scope: Scope) -> Value:
        return strict(self.inner.value(scope), scope.resolve_type(self.target))


@dataclass(frozen=True)
class Ternary(Expr):
    condition: Expr
    then: Expr
    other: Expr

    def value(self, scope: Scope) -> Value:
        test, a, b = self.condition.test(scope), self.then.value(scope), self.other.value(scope)
        kind = common([a.type, b.type])
        cast = lambda v: text(v) if isinstance(kind, T.StringType) else v.col.cast(kind)
        return Value(F.when(test, cast(a)).otherwise(cast(b)), kind)


@dataclass(frozen=True)
class Subquery(Expr):
    """A relation of one row and one attribute as a value."""

    relation: Any

    def value(self, scope: Scope) -> Value:
        return scope.scalar(self.relation)


@dataclass(frozen=True)
class Agg(Expr):
    """An aggregate; of a group, of a nested relation (name), or of a named relation."""

    op: str
    name: str | None
    attr: str | None
    relation: Any

    def value(self, scope: Scope) -> Value:
        return scope.aggregate(self)


@dataclass(frozen=True)
class Logic(Expr):
    op: str
    left: Expr
    right: Expr

    def test(self, scope: Scope) -> Column:
        a, b = self.left.test(scope), self.right.test(scope)
        return a & b if self.op == "&" else a | b


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr

    def test(self, scope: Scope) -> Column:
        left = self.left.value(scope)
        if self.op in ("=~", "!=~"):
            found = self._matches(text(left), scope)
            return ~found if self.op == "!=~" else found
        right = self.right
        relation = right.relation if isinstance(right, Subquery) else None
        if isinstance(right, Attr) and not scope.has(right.name) and scope.is_relation(right.name):
            relation = scope.named(right.name)
        if relation is not None and self.op in ("=", "!="):
            member = scope.member(left, relation, loose=True)
            return ~member if self.op == "!=" else member
        b = scope.scalar(relation) if relation is not None else right.value(scope)
        return compare(self.op, left, b, right.raw if isinstance(right, Lit) else None)

    def _matches(self, s: Column, scope: Scope) -> Column:
        if isinstance(self.right, Lit):
            return s.rlike(patterns.java(str(self.right.raw)))
        return F.regexp_like(s, patterns.java_column(text(self.right.value(scope))))


@dataclass(frozen=True)
class InSet(Expr):
    """Membership in listed values, without coercion."""

    left: Expr
    values: list
    negated: bool

    def test(self, scope: Scope) -> Column:
        left = self.left.value(scope)
        raw = []
        for x in self.values:
            if not isinstance(x, Lit) or isinstance(x.raw, bool):
                raise QueryError("a set holds numbers and strings")
            fits = isinstance(x.raw, str) if isinstance(left.type, T.StringType) else is_number(left.type) and not isinstance(x.raw, str)
            if fits:
                raw.append(x.raw)
        found = left.col.isin(raw) if raw else F.lit(False)
        return ~found if self.negated else found


@dataclass(frozen=True)
class Member(Expr):
    left: Expr
    relation: Any

    def test(self, scope: Scope) -> Column:
        return scope.member(self.left.value(scope), self.relation)


def nested_aggregate(op: str, v: Value, attr: str | None) -> Value:
    """An aggregate of the rows of a nested relation, by higher-order functions."""
    if not is_nested(v.type):
        raise QueryError(f"an aggregate needs a nested relation, not {type_name(v.type)}")
    if op == "count":
        return Value(F.size(v.col).cast("long"), T.LongType())
    if op == "collect" and attr is None:
        return v
    fields = {f.name: f.dataType for f in v.type.elementType.fields}
    if attr not in fields:
        raise QueryError(f"unknown attribute {attr!r} of the nested relation")
    kind = fields[attr]
    values = F.transform(v.col, lambda x: x[attr])
    if op == "collect":
        one = T.ArrayType(T.StructType([T.StructField(attr, kind)]), False)
        return Value(F.array_sort(F.array_distinct(F.transform(v.col, lambda x: F.struct(x[attr].alias(attr))))), one)
    empty = F.size(v.col) == 0
    if op in ("max", "min"):
        found = F.array_max(values) if op == "max" else F.array_min(values)
        return Value(F.when(empty, F.raise_error(F.lit(f"{op} of no rows")).cast(kind)).otherwise(found), kind)
    if isinstance(kind, T.StringType):
        kind = T.DecimalType(38, 18)
        values = F.transform(values, lambda x: x.cast(kind))
    if not is_number(kind):
        raise QueryError(f"{op} needs numbers, not {type_name(kind)}")
    total = F.aggregate(values, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))
    if op == "sum":
        return Value(total, kind)
    if op == "mean":
        mean = total.cast(FLOAT) / F.when(empty, F.raise_error(F.lit("mean of no rows")).cast("int")).otherwise(F.size(v.col))
        return Value(mean.cast(kind) if isinstance(kind, T.DecimalType) else mean, kind if isinstance(kind, T.DecimalType) else FLOAT)
    raise QueryError(f"{op} does not apply to a nested relation")
