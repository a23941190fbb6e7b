"""Relations as text: tables, blocks and CSV."""

from __future__ import annotations

import csv
import datetime
import io

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.functions.values import Value, is_nested, text
from quillon.operators.relation import Relation
from quillon.operators.scopes import column

#: Rows that a display shows.
SHOWN = 1000


def shown(value) -> str:
    """A value as a cell; nested relations as ``{(a: 1, b: "x"), ...}``."""
    if isinstance(value, list):
        return "{" + ", ".join(shown(v) for v in value) + "}"
    if isinstance(value, Row):
        cells = (f'{k}: "{v}"' if isinstance(v, str) else f"{k}: {shown(v)}" for k, v in value.asDict().items())
        return "(" + ", ".join(cells) + ")"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def _cells(relation: Relation, limit: int | None) -> tuple[list[str], list[list[str]]]:
    this = relation if relation.ordered else relation.as_set()
    names = this.df.columns if this.ordered else sorted(this.df.columns)
    df = this.df if limit is None else this.df.limit(limit)
    rows = [[shown(r[n]) for n in names] for r in df.collect()]
    return names, rows if this.ordered else sorted(rows)


def table(relation: Relation, limit: int = SHOWN) -> str:
    """A bordered table; a rotated relation gives one block for each row. Rows beyond the limit are
    not shown, which a last line says."""
    names, rows = _cells(relation, limit + 1)
    more = f"\n(more than {limit} rows; the rest is not shown)" if len(rows) > limit else ""
    rows = rows[:limit]
    if relation.vertical:
        width = max(map(len, names), default=0)
        return "\n\n".join("\n".join(f"{n.ljust(width)} : {c}" for n, c in zip(names, r, strict=True)) for r in rows) + more
    if not names:
        return "(no attributes)"
    widths = [max(map(len, [n, *(r[i] for r in rows)])) for i, n in enumerate(names)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    shape = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    return "\n".join([line, shape(names), line, *map(shape, rows), line]) + more


def as_csv(relation: Relation, header: bool = True) -> str:
    names, rows = _cells(relation, None)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    if header:
        writer.writerow(names)
    writer.writerows(rows)
    return out.getvalue()


def write_csv(relation: Relation, path: str, header: bool = True) -> None:
    """Written by the executors, as a folder of CSV files."""
    this = relation if relation.ordered else relation.as_set()
    types = this.types
    cols = [F.to_json(column(n)).alias(n) if is_nested(types[n]) else text(Value(column(n), types[n])).alias(n) for n in this.df.columns]
    this.df.select(*cols).write.mode("overwrite").option("header", header).option("escape", '"').csv(path)
