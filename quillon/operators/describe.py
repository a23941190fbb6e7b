"""Column profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.values import INT, STR, WIDE, Value, is_nested, text, type_name
from quillon.operators.relation import Relation
from quillon.operators.scopes import column

HEADING = ["attr", "type", "inferred", "distinct", "pct", "empty", "min", "max", "sample"]


def described(relation: Relation, full: bool) -> Relation:
    """One row for each attribute: attr type inferred distinct pct empty min max sample.

    One aggregation over all rows; its single row is then turned into rows. inferred is the
    narrowest type that all values fit; pct is distinct values per hundred rows.
    """
    names = sorted(relation.heading)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(names):
        aggs += [c.alias(f"{k}_{i}") for k, c in _facts(Value(column(n), relation.types[n])).items()]
    facts = relation.df.agg(*aggs)
    known = {n: type_name(t) for n, t in relation.types.items()} | (relation.declared or {})
    rows = F.array(*[_row(i, n, known[n], relation.types[n], full) for i, n in enumerate(names)])
    df = facts.select(F.inline(rows).alias(*HEADING))
    return Relation(df, keys=(frozenset(["attr"]),), session=relation.session)


def _facts(v: Value) -> dict[str, Column]:
    if is_nested(v.type) or isinstance(v.type, T.ArrayType):
        return {"distinct": F.count_distinct(v.col), "empty": F.count_if(F.lit(False))}
    if not isinstance(v.type, T.StringType):
        out = {
            "distinct": F.count_distinct(v.col),
            "empty": F.count_if(v.col.isNull()),
            "min": text(Value(F.min(v.col), v.type)),
            "max": text(Value(F.max(v.col), v.type)),
        }
        if v.type == INT:
            out["bits"] = F.count_if(~v.col.isin(0, 1))
        return out
    some = F.when(v.col != "", v.col)
    number, day = some.try_cast(WIDE), F.when(some.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(some))
    whole = F.when(some.rlike(r"^\s*[-+]?\d+\s*$"), number)
    flag = F.lower(some).isin("true", "false")
    return {
        "distinct": F.count_distinct(v.col),
        "empty": F.count_if(v.col == ""),
        "filled": F.count(some),
        "whole": F.count(whole),
        "bits": F.count_if(~whole.isin(0, 1)),
        "number": F.count(number),
        "flag": F.count_if(flag),
        "day": F.count(day),
        "min": F.min(some),
        "max": F.max(some),
        "n_min": F.min_by(some, number),
        "n_max": F.max_by(some, number),
    }


def _row(i: int, name: str, declared: str, kind: T.DataType, full: bool) -> Column:
    f = lambda k: F.col(f"{k}_{i}")
    none = F.lit("")
    if is_nested(kind) or isinstance(kind, T.ArrayType):
        inferred, low, high = F.lit("relation" if is_nested(kind) else "str"), none, none
    elif isinstance(kind, T.StringType):
        empty = f("filled") == 0
        whole, number = f("whole") == f("filled"), f("number") == f("filled")
        inferred = (
            F.when(empty, F.lit("str"))
            .when(whole & (f("bits") == 0), F.lit("bool"))
            .when(whole, F.lit("int"))
            .when(number, F.lit("decimal"))
            .when(f("flag") == f("filled"), F.lit("bool"))
            .when(f("day") == f("filled"), F.lit("date"))
            .otherwise(F.lit("str"))
        )
        low, high = (F.when(number, f(f"n_{k}")).otherwise(f(k)) for k in ("min", "max"))
    else:
        inferred = F.lit(type_name(kind).partition("(")[0])
        if kind == INT:
            inferred = F.when((f("bits") == 0) & (F.col("rows") > 0), F.lit("bool")).otherwise(F.lit("int"))
        low, high = f("min"), f("max")
    shown = F.lit(True) if full else inferred != "str"
    low, high = (F.when(shown, F.coalesce(x, none)).otherwise(none) for x in (low, high))
    share = F.when(F.col("rows") > 0, F.bround(f("distinct") * 100 / F.col("rows")).cast(INT)).otherwise(F.lit(0))
    values = [
        F.lit(name), F.lit(declared), inferred, f("distinct").cast(INT), share.cast(INT), f("empty").cast(INT),
        low, high, low,
    ]
    return F.struct(*[v.cast(STR if n in ("attr", "type", "inferred", "min", "max", "sample") else INT).alias(n)
                      for v, n in zip(values, HEADING, strict=True)])
