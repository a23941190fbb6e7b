"""Typed columns, coercions and strict casts.

Every attribute has one Spark type: bigint, double, decimal(38, s), string, date, boolean, or an
array of structs for a nested relation. Other types pass through untouched.
"""

from __future__ import annotations

import datetime
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, FLOAT, STR, DATE, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.DateType(), T.BooleanType()
WIDE = T.DecimalType(38, 18)
#: Python's white space, for trimming as str.strip does.
SPACE = r"(?U)[\s\x1c-\x1f]+"
ISO = r"^\d{4}-\d{2}-\d{2}$"


class QueryError(ValueError):
    """The query does not fit its relations."""


class Value(NamedTuple):
    col: Column
    type: T.DataType


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.LongType, T.DoubleType, T.DecimalType))


def is_nested(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)


def type_name(t: T.DataType) -> str:
    """The language's name of a Spark type."""
    if isinstance(t, T.DecimalType):
        return "decimal" if t.scale == 18 else f"decimal({t.scale})"
    names = {T.LongType: "int", T.DoubleType: "float", T.StringType: "str", T.DateType: "date", T.BooleanType: "bool"}
    return names.get(type(t), "relation" if is_nested(t) else t.simpleString())


def spark_type(name: str) -> T.DataType:
    found = re.fullmatch(r"decimal\((\d+)\)", name)
    if found:
        return T.DecimalType(38, int(found[1]))
    named = {"int": INT, "float": FLOAT, "str": STR, "date": DATE, "bool": BOOL, "decimal": WIDE}
    if name not in named:
        raise QueryError(f"unknown type {name!r}")
    return named[name]


def literal(value) -> Value:
    if isinstance(value, bool):
        return Value(F.lit(value), BOOL)
    if isinstance(value, int):
        return Value(F.lit(value).cast(INT), INT)
    if isinstance(value, float):
        return Value(F.lit(value), FLOAT)
    if isinstance(value, datetime.date):
        return Value(F.lit(value), DATE)
    return Value(F.lit(value), STR)


def number(v: Value, what: str = "arithmetic") -> Value:
    """Strings are read as decimals, an error for other text; numbers stay."""
    if isinstance(v.type, T.StringType):
        return Value(v.col.cast(WIDE), WIDE)
    if not is_number(v.type):
        raise QueryError(f"{what} needs numbers, not {type_name(v.type)}")
    return v


def date(v: Value) -> Value:
    """Dates stay; strings must be ISO dates or ``today``, which is fixed when the query is built."""
    if isinstance(v.type, T.DateType):
        return v
    if isinstance(v.type, (T.TimestampNTZType, T.TimestampType)):
        return Value(v.col.cast(DATE), DATE)
    if not isinstance(v.type, T.StringType):
        raise QueryError(f"no date can be made of {type_name(v.type)}")
    today = F.lit(datetime.date.today())
    read = F.when(F.lower(v.col) == "today", today).when(v.col.rlike(ISO), F.try_to_date(v.col))
    return Value(F.coalesce(read, _refused(v.col, "date").cast(DATE)), DATE)


def text(v: Value) -> Column:
    """As text: dates in ISO form, booleans capitalised."""
    if isinstance(v.type, T.BooleanType):
        return F.when(v.col, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(v.type, T.DoubleType):
        plain = F.format_string("%.1f", v.col)
        return F.when((v.col == F.floor(v.col)) & (F.abs(v.col) < 1e16), plain).otherwise(v.col.cast(STR))
    return v.col.cast(STR)


def _refused(col: Column, wanted: str) -> Column:
    return F.raise_error(F.concat(F.lit("cannot coerce "), F.coalesce(col.cast(STR), F.lit("null")), F.lit(f" to {wanted}")))


def strict(v: Value, target: T.DataType) -> Value:
    """The cast of ``::`` and ``.as``: exact or an error."""
    t, name = v.type, type_name(target)
    if t == target:
        return v
    if isinstance(target, T.StringType):
        return Value(text(v), STR)
    if isinstance(target, T.DateType):
        return date(v)
    source = F.regexp_replace(v.col, f"^{SPACE}|{SPACE}$", "") if isinstance(t, T.StringType) else v.col
    if isinstance(target, T.BooleanType):
        if not isinstance(t, T.StringType):
            raise QueryError(f"cannot coerce {type_name(t)} to bool")
        low = F.lower(v.col)
        read = F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
        return Value(F.coalesce(read, _refused(v.col, name).cast(BOOL)), BOOL)
    if not (is_number(t) or isinstance(t, T.StringType)):
        raise QueryError(f"cannot coerce {type_name(t)} to {name}")
    if isinstance(target, T.LongType):
        exact = source.try_cast(T.DecimalType(38, 9)) if not isinstance(t, T.DoubleType) else source
        whole = exact.try_cast(INT)
        read = F.when(whole == exact, whole)
    elif isinstance(target, T.DoubleType):
        read = source.try_cast(FLOAT)
    else:
        read = (source.cast(STR) if isinstance(t, T.DoubleType) else source).try_cast(target)
    return Value(F.coalesce(read, _refused(v.col, name).cast(target)), target)


def common(types: list[T.DataType]) -> T.DataType:
    """The type of values that meet in one column; text if they have nothing else in common."""
    kinds = list(dict.fromkeys(map(type, types)))
    if len(kinds) == 1 and kinds[0] is not T.DecimalType:
        return types[0]
    if all(map(is_number, types)):
        if T.DoubleType in kinds:
            return FLOAT
        return T.DecimalType(38, max(t.scale for t in types if isinstance(t, T.DecimalType)))
    return STR


def compare(op: str, a: Value, b: Value, b_literal=None) -> Column:
    """A comparison after coercion: dates win over text, numbers over text; text with text is
    numeric where both sides read as numbers."""
    kinds = {type(a.type), type(b.type)}
    if kinds == {T.StringType}:
        loose = b_literal is None or _numeric(str(b_literal))
        if not loose and op in ("=", "!="):
            return _op(op, a.col, b.col)
        left, right = a.col.try_cast(WIDE), b.col.try_cast(WIDE)
        return F.when(left.isNotNull() & right.isNotNull(), _op(op, left, right)).otherwise(_op(op, a.col, b.col))
    stamps = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if any(isinstance(v.type, stamps) for v in (a, b)):
        if isinstance(a.type, T.StringType):
            a = date(a)
        if isinstance(b.type, T.StringType):
            b = date(b)
        return _op(op, a.col, b.col)
    if T.StringType in kinds and any(is_number(v.type) for v in (a, b)):
        a, b = (Value(v.col.try_cast(WIDE), WIDE) if isinstance(v.type, T.StringType) else v for v in (a, b))
        return F.coalesce(_op(op, a.col, b.col), F.lit(op == "!="))
    return _op(op, a.col, b.col)


def _numeric(s: str) -> bool:
    return bool(re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", s))


def _op(op: str, a: Column, b: Column) -> Column:
    return {
        "=": lambda: a == b,
        "!=": lambda: a != b,
        ">": lambda: a > b,
        "<": lambda: a < b,
        ">=": lambda: a >= b,
        "<=": lambda: a <= b,
    }[op]()


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """One step of arithmetic; a date with a number or another date counts days."""
    if any(isinstance(v.type, T.DateType) for v in (a, b)):
        return _days(op, a, b)
    a, b = number(a), number(b)
    out = common([a.type, b.type])
    if isinstance(out, T.DoubleType):
        a, b = Value(a.col.cast(FLOAT), FLOAT), Value(b.col.cast(FLOAT), FLOAT)
    if op == "/":
        if isinstance(out, T.DecimalType):
            scale = max(out.scale, 10)
            return Value((a.col.cast(T.DecimalType(28, min(scale, 12))) / b.col.cast(T.DecimalType(24, min(scale, 10)))).cast(WIDE), WIDE)
        return Value(a.col.cast(FLOAT) / b.col.cast(FLOAT), FLOAT)
    if op in ("//", "%"):
        return Value(_floored(op, a.col, b.col, out).cast(out), out)
    col = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col}[op]()
    return Value(col.cast(out) if isinstance(out, T.DecimalType) else col, out)


def _floored(op: str, a: Column, b: Column, out: T.DataType) -> Column:
    """Quotient rounded down, remainder with the divisor's sign; decimals go toward zero."""
    rest = a % b
    if isinstance(out, T.DecimalType):
        return rest if op == "%" else (a - rest) / b
    other = (rest != 0) & ((rest < 0) != (b < 0))
    if op == "%":
        return F.when(other, rest + b).otherwise(rest)
    if isinstance(out, T.DoubleType):
        return F.when(other, (a - rest) / b - 1).otherwise((a - rest) / b)
    whole = F.call_function("div", a, b) if False else F.floor((a - rest).cast(T.DecimalType(38, 0)) / b)
    return F.when(other, whole - 1).otherwise(whole)


def _days(op: str, a: Value, b: Value) -> Value:
    if op == "-" and not is_number(b.type):
        return Value(F.datediff(date(a).col, date(b).col).cast(INT), INT)
    if op == "+" and isinstance(a.type, T.LongType):
        a, b = b, a
    if op not in ("+", "-") or not isinstance(b.type, T.LongType):
        raise QueryError(f"a date does not take {op} here")
    days = b.col.cast("int")
    return Value(F.date_add(date(a).col, days if op == "+" else -days), DATE)
