"""Relations as lazy DataFrames.

A ``Relation`` wraps a DataFrame with what a bag engine does not know: whether its rows are known
to be a set, which attributes are keys, which types were declared, and whether it is an ordered
array that has left the algebra. Duplicates are removed only where an operator could make or
meet them. Every method returns a new relation; nothing runs before a sink.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import patterns
from quillon.functions.expressions import Agg, Cast, Expr
from quillon.functions.values import (
    FLOAT,
    INT,
    STR,
    QueryError,
    Value,
    is_nested,
    spark_type,
    strict,
    type_name,
)
from quillon.operators.scopes import (
    FRESH,
    GroupScope,
    Scope,
    canonical,
    column,
    meeting,
    nested_type,
    values,
)

Keys = tuple[frozenset, ...]


def _bound(t: T.DataType) -> T.DataType:
    """The type that an attribute of this Spark type has: one integer and one float type."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return INT
    if isinstance(t, T.FloatType):
        return FLOAT
    if isinstance(t, T.DecimalType):
        return T.DecimalType(38, t.scale)
    return t


class Relation:
    def __init__(
        self,
        df: DataFrame,
        *,
        distinct: bool = False,
        keys: Keys = (),
        declared: dict[str, str] | None = None,
        ordered: bool = False,
        vertical: bool = False,
        session=None,
    ):
        self.df, self.distinct, self.keys = df, distinct or bool(keys), keys
        self.declared, self.ordered, self.vertical, self.session = declared, ordered, vertical, session

    @classmethod
    def bind(
        cls, df: DataFrame, key: Iterable[str] | None = None, trusted: bool = False, session=None
    ) -> Relation:
        """A relation of a DataFrame's rows. key: attributes known to be unique; trusted: the rows
        are known to be distinct. Otherwise duplicates go when an operator first needs a set."""
        names = list(df.columns)
        if len(set(names)) < len(names):
            raise QueryError("two attributes have one name")
        cols = []
        for f in df.schema:
            kind = _bound(f.dataType)
            cols.append(column(f.name).cast(kind).alias(f.name) if kind != f.dataType else column(f.name))
        keys = (frozenset(key),) if key else ()
        return cls(df.select(*cols), distinct=trusted, keys=keys, session=session)

    # -- what it is

    @property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema}

    @property
    def heading(self) -> set[str]:
        return set(self.df.columns)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def as_set(self) -> Relation:
        if self.ordered:
            raise QueryError("a sorted or ordered result is no relation; only $. ^ and r. may follow")
        return self if self.distinct else self._with(self.df.distinct(), distinct=True)

    def _with(self, df: DataFrame, **changes) -> Relation:
        known = {
            "distinct": self.distinct, "keys": self.keys, "declared": self.declared,
            "ordered": self.ordered, "vertical": self.vertical, "session": self.session,
        }
        return Relation(df, **(known | changes))

    def _need(self, names: Iterable[str]) -> list[str]:
        names = list(names)
        if missing := [n for n in names if n not in self.heading]:
            raise QueryError(f"unknown attribute {missing[0]!r} (have: {', '.join(sorted(self.heading))})")
        return names

    def _kept_keys(self, names: set[str]) -> Keys:
        return tuple(k for k in self.keys if k <= names)

    def _declared(self, names: Iterable[str]) -> dict[str, str] | None:
        return None if self.declared is None else {n: self.declared[n] for n in names if n in self.declared}

    def _fresh(self, name: str) -> str:
        if name in self.heading:
            raise QueryError(f"attribute {name!r} is there already")
        return name

    def _tree(self, given) -> Expr:
        from quillon.lang import syntax

        return syntax.parse_condition(given) if isinstance(given, str) else given

    def _named(self, given) -> list[tuple[str, Expr]]:
        from quillon.lang import syntax

        pairs = given.items() if isinstance(given, dict) else given
        return [(n, syntax.parse_scalar(e) if isinstance(e, str) else e) for n, e in pairs]

    # -- filters and projections

    def where(self, test: str | Expr) -> Relation:
        """Rows for which the condition holds."""
        return self._filtered(test, lambda found: found)

    def where_not(self, test: str | Expr) -> Relation:
        """The other rows."""
        return self._filtered(test, lambda found: ~F.coalesce(found, F.lit(False)))

    def _filtered(self, test: str | Expr, keep) -> Relation:
        this = self.as_set()
        scope = Scope(this, self.session)
        found = keep(self._tree(test).test(scope))
        df = scope.flagged(this.df).where(found)
        return this._with(df.select(*map(column, this.df.columns)) if scope.flags else df)

    def project(self, names: Sequence[str]) -> Relation:
        this = self.as_set()
        names = list(dict.fromkeys(this._need(names)))
        keys = this._kept_keys(set(names))
        df = this.df.select(*map(column, names))
        whole = set(names) == this.heading
        return this._with(
            df if keys or whole else df.distinct(), distinct=True, keys=keys, declared=this._declared(names)
        )

    def remove(self, names: Sequence[str]) -> Relation:
        gone = set(self._need(names))
        return self.project([n for n in self.df.columns if n not in gone])

    def rename(self, pairs: Sequence[tuple[str, str]] | dict[str, str]) -> Relation:
        """All renamings at once, so two attributes may swap names."""
        this = self.as_set()
        new = dict(pairs)
        this._need(new)
        names = [new.get(n, n) for n in this.df.columns]
        if len(set(names)) < len(names):
            raise QueryError("a renaming would give two attributes one name")
        df = this.df.select(*[column(n).alias(m) for n, m in zip(this.df.columns, names, strict=True)])
        keys = tuple(frozenset(new.get(n, n) for n in k) for k in this.keys)
        declared = None if this.declared is None else {new.get(n, n): t for n, t in this.declared.items()}
        return this._with(df, keys=keys, declared=declared)

    def extend(self, named) -> Relation:
        """New attributes, each computed from the row as it was."""
        this = self.as_set()
        named = this._named(named)
        for name, _ in named:
            this._fresh(name)
        if len(dict(named)) < len(named):
            raise QueryError("two new attributes have one name")
        scope = Scope(this, self.session)
        found = values(named, scope)
        df = scope.flagged(this.df).select(*map(column, this.df.columns), *[v.col.alias(n) for n, v in found.items()])
        declared = this.declared
        casts = {n: e.target for n, e in named if isinstance(e, Cast)}
        if declared is not None or casts:
            declared = (declared or {}) | casts
        return this._with(df, declared=declared)

    def modify(self, named) -> Relation:
        """New values for attributes, each computed from the row as it was. A declared type is
        kept unless the expression ends in a cast."""
        this = self.as_set()
        named = this._named(named)
        this._need(n for n, _ in named)
        scope = Scope(this, self.session)
        found = values(named, scope)
        declared = this.declared
        for name, expr in named:
            if isinstance(expr, Cast):
                declared = (declared or {}) | {name: expr.target}
            elif declared and name in declared:
                wanted = scope.resolve_type(declared[name])
                v = found[name]
                if type_name(v.type) != type_name(wanted) and not isinstance(wanted, T.StringType):
                    raise QueryError(f"{name} is declared {declared[name]}; use .as to change its type")
        cols = [found[n].col.alias(n) if n in found else column(n) for n in this.df.columns]
        df = scope.flagged(this.df).select(*cols)
        keys = tuple(k for k in this.keys if not k & set(found))
        return this._with(df if keys else df.distinct(), keys=keys, distinct=True, declared=declared)

    # -- joins

    def natural_join(self, other: Relation) -> Relation:
        """Rows that agree on all shared attributes; without any, all pairs of rows."""
        a, b = self.as_set(), other.as_set()
        shared = [n for n in a.df.columns if n in b.heading]
        types = {n: t for n, t in a.types.items()} | b.types
        declared = (a.declared or {}) | (b.declared or {}) or None
        if not shared:
            df = a.df.crossJoin(b.df)
            keys = tuple(j | k for j in a.keys for k in b.keys)
            return a._with(df, keys=keys, distinct=True, declared=declared)
        if set(shared) == a.heading == b.heading and all(a.types[n] == b.types[n] for n in shared):
            return a._with(a.df.join(b.df, shared, "left_semi"), declared=declared)
        exact = all(a.types[n] == b.types[n] for n in shared)
        if exact:
            df = a.df.join(b.df, shared)
        else:
            df = _coerced_join(a, b, shared, "inner").select(
                *[column(f"_r_{n}").alias(n) if n in shared else column(n) for n in types]
            )
        keys = tuple(dict.fromkeys(j | k for j in a.keys for k in b.keys)) if exact else ()
        if exact and any(k <= set(shared) for k in b.keys):
            keys = a.keys + keys
        if exact and any(k <= set(shared) for k in a.keys):
            keys = b.keys + keys
        return a._with(df if exact else df.distinct(), keys=keys, distinct=True, declared=declared)

    def left_join(self, other: Relation, defaults=()) -> Relation:
        """All rows of the left, with the right's attributes where it has a match and defaults
        where not. A row without a match and a default is an error."""
        a, b = self.as_set(), other.as_set()
        shared = [n for n in a.df.columns if n in b.heading]
        extra = [n for n in b.df.columns if n not in a.heading]
        given = {n: v for n, v in values(a._named(defaults), Scope(a, self.session)).items() if n in extra}
        missing = [n for n in extra if n not in given]
        mark = f"_mark{next(FRESH)}"
        right = b.df.withColumn(mark, F.lit(True))
        if shared:
            joined = _coerced_join(a, b._with(right), shared, "left", also=[mark])
        else:
            joined = a.df.join(right, F.lit(True), "left")
        alone = column(mark).isNull()
        if missing:
            guard = F.when(
                alone, F.raise_error(F.lit(f"no match, and no default for {', '.join(sorted(missing))}")).cast("boolean")
            ).otherwise(F.lit(True))
            joined = joined.where(guard)
        cols = [column(n) for n in a.df.columns]
        for n in extra:
            value = column(n)
            if n in given:
                value = F.when(alone, _to(given[n], b.types[n])).otherwise(value)
            cols.append(value.alias(n))
        exact = all(a.types[n] == b.types[n] for n in shared)
        unique = any(k <= set(shared) for k in b.keys)
        keys = a.keys if unique else tuple(j | k for j in a.keys for k in b.keys)
        df = joined.select(*cols)
        declared = (a.declared or {}) | (b.declared or {}) or None
        return a._with(df if exact else df.distinct(), keys=keys if exact else (), distinct=True, declared=declared)

    def nest_join(self, name: str, other: Relation) -> Relation:
        """Every row of the left with its matches on the right as a nested relation."""
        a, b = self.as_set(), other.as_set()
        a._fresh(name)
        shared = [n for n in a.df.columns if n in b.heading]
        rest = {n: t for n, t in b.types.items() if n not in shared}
        if not rest:
            raise QueryError("nothing is left to nest")
        kind = nested_type(rest)
        if not shared:
            whole = b.df.agg(canonical(list(rest)).alias(name))
            return a._with(a.df.crossJoin(F.broadcast(whole)), declared=None)
        grouped = b.df.groupBy(*map(column, shared)).agg(canonical(list(rest)).alias(name))
        right = Relation(grouped)
        joined = _coerced_join(a, right, shared, "left", also=[name])
        empty = F.array().cast(kind)
        df = joined.select(*map(column, a.df.columns), F.coalesce(column(name), empty).alias(name))
        return a._with(df, declared=None)

    def semi_join(self, other: Relation) -> Relation:
        a, b = self.as_set(), other.as_set()
        return a._with(a.df.join(b.df, [n for n in a.df.columns if n in b.heading], "left_semi"))

    def anti_join(self, other: Relation) -> Relation:
        a, b = self.as_set(), other.as_set()
        return a._with(a.df.join(b.df, [n for n in a.df.columns if n in b.heading], "left_anti"))

    # -- sets

    def _like(self, other: Relation) -> tuple[Relation, Relation]:
        """Both sides, the other with this one's order of attributes and types."""
        a, b = self.as_set(), other.as_set()
        if a.heading != b.heading:
            raise QueryError(f"the headings differ: {sorted(a.heading)} and {sorted(b.heading)}")
        cols = [_to(Value(column(n), b.types[n]), a.types[n]).alias(n) for n in a.df.columns]
        return a, b._with(b.df.select(*cols))

    def union(self, other: Relation) -> Relation:
        a, b = self._like(other)
        out = a._with(a.df.union(b.df).distinct(), keys=(), distinct=True)
        return out._enforced(out.declared)

    def difference(self, other: Relation) -> Relation:
        a, b = self._like(other)
        return a._with(a.df.subtract(b.df))

    def intersect(self, other: Relation) -> Relation:
        a, b = self._like(other)
        return a._with(a.df.intersect(b.df))

    # -- aggregation

    def summarize(self, keys: Sequence[str] | None, named) -> Relation:
        """One row of aggregates for each group, or one row for the whole relation."""
        this = self.as_set()
        named = this._named(named)
        keys = this._need(keys or [])
        for name, _ in named:
            if name in keys:
                raise QueryError(f"{name} is a group key already")
        df, found = this._aggregated(keys, named)
        out = df.select(*map(column, keys), *[column(n) for n in found])
        declared = this._result_types(keys, named)
        unique = (frozenset(keys),) if keys else ()
        return this._with(out, keys=unique, distinct=True, declared=declared)

    def _aggregated(self, keys: list[str], named) -> tuple[DataFrame, dict[str, T.DataType]]:
        scope = GroupScope(self, self.session)
        found = values(named, scope)
        source = self.df
        if scope.shares and keys:
            # The whole sums that percentages are of: one row, beside every row.
            totals = {n: f"_total{next(FRESH)}" for n in sorted(scope.shares)}
            summed = source.agg(*[F.sum(_numeric(self, n)).alias(t) for n, t in totals.items()])
            grouped = source.crossJoin(F.broadcast(summed))
            scope = GroupScope(self, self.session, {n: F.max(column(t)) for n, t in totals.items()})
            found = values(named, scope)
            source = grouped
        cols = [v.col.alias(n) for n, v in found.items()]
        df = source.groupBy(*map(column, keys)).agg(*cols) if keys else source.agg(*cols)
        return df, {n: v.type for n, v in found.items()}

    def _result_types(self, keys: list[str], named) -> dict[str, str] | None:
        if self.declared is None:
            return None
        out = {k: self.declared[k] for k in keys if k in self.declared}
        for name, expr in named:
            if isinstance(expr, Agg):
                kept = self.declared.get(expr.name or "")
                kind = {"count": "int", "mean": "float", "pct": "float"}.get(expr.op, kept)
                if kind and expr.op != "collect":
                    out[name] = kind
        return out

    def broadcast(self, keys: Sequence[str] | None, named) -> Relation:
        """The aggregates of its group, or of the whole relation, beside every row. The groups'
        rows are counted once and joined back, so a large group is no single task's work."""
        this = self.as_set()
        named = this._named(named)
        keys = this._need(keys or [])
        for name, _ in named:
            this._fresh(name)
        if keys:
            share = GroupScope(this, self.session)
            values(named, share)
            df, found = this._aggregated(keys, named)
            out = this.df.join(df, keys).select(*map(column, this.df.columns), *map(column, found))
        else:
            df, found = this._aggregated([], named)
            out = this.df.crossJoin(F.broadcast(df))
        return this._with(out, declared=this.declared)

    def nest_by(self, name: str, keys: Sequence[str]) -> Relation:
        """Groups with the rest of their rows as a nested relation."""
        this = self.as_set()
        keys = this._need(keys)
        rest = [n for n in this.df.columns if n not in keys]
        if not rest:
            raise QueryError("nothing is left to nest")
        if name in keys:
            raise QueryError(f"attribute {name!r} is there already")
        df = this.df.groupBy(*map(column, keys)).agg(canonical(rest).alias(name))
        return this._with(df, keys=(frozenset(keys),), distinct=True, declared=None)

    def unnest(self, name: str) -> Relation:
        """One row for each row of a nested relation; its attributes win over the parent's."""
        this = self.as_set()
        this._need([name])
        if not is_nested(this.types[name]):
            raise QueryError(f"{name} is {type_name(this.types[name])}, not a relation")
        inner = [f.name for f in this.types[name].elementType.fields]
        kept = [n for n in this.df.columns if n != name and n not in inner]
        df = this.df.select(*map(column, kept), F.inline(column(name)))
        safe = any(k <= set(kept) for k in this.keys)
        return this._with(df if safe else df.distinct(), keys=(), distinct=True, declared=None)

    # -- order

    def _order(self, keys: Sequence[tuple[str, bool]]) -> list[Column]:
        self._need(n for n, _ in keys)
        return [column(n).desc() if down else column(n).asc() for n, down in keys]

    def _ranked(self, keys: Sequence[tuple[str, bool]], rank: str) -> DataFrame:
        """The distinct sort keys with their dense rank. Ranks of a partition start where those
        before it end: partitions are ranges of the keys, counted first, so no task sees all. The
        ranges are kept on the executors' disks, as counting and ranking must see the same ones;
        sampled a second time, their borders could differ."""
        names = [n for n, _ in keys]
        order = self._order(keys)
        part, own, before = (f"_{x}{next(FRESH)}" for x in ("part", "own", "before"))
        distinct = self.df.select(*map(column, dict.fromkeys(names))).distinct()
        ranges = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
        ranges = ranges.withColumn(own, F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
        # The id's upper bits are the partition, its lower 33 bits the row's place in it.
        ranges = ranges.withColumn(part, F.shiftright(own, 33)).withColumn(own, column(own).bitwiseAND((1 << 33) - 1) + 1)
        counts = ranges.groupBy(part).agg(F.count(F.lit(1)).alias(before))
        starts = counts.withColumn(
            before,
            F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        return (
            ranges.join(F.broadcast(starts), part)
            .withColumn(rank, (column(own) + column(before)).cast(INT))
            .drop(part, own, before)
        )

    def rank(self, name: str, keys: Sequence[tuple[str, bool]]) -> Relation:
        """Dense rank over the whole relation; rows with equal keys share one."""
        this = self.as_set()
        this._fresh(name)
        names = list(dict.fromkeys(n for n, _ in keys))
        df = this.df.join(this._ranked(keys, name), names)
        return this._with(df.select(*map(column, [*this.df.columns, name])))

    def bucket(self, name: str, keys: Sequence[tuple[str, bool]], n: int) -> Relation:
        """Buckets 1 to n of equal numbers of ranks; rows with equal keys share one."""
        if n < 1:
            raise QueryError("the number of buckets must be positive")
        rank, top = f"_rank{next(FRESH)}", f"_top{next(FRESH)}"
        ranked = self.rank(rank, keys)
        self._fresh(name)
        most = ranked.df.agg(F.max(rank).alias(top))
        share = F.floor(((column(rank) - 1) * n).cast(T.DecimalType(38, 0)) / column(top)).cast(INT) + 1
        df = ranked.df.crossJoin(F.broadcast(most)).withColumn(name, share)
        return ranked._with(df.select(*map(column, [*self.df.columns, name])))

    def sort(self, keys: Sequence[tuple[str, bool]]) -> Relation:
        """An array in this order; ties in any order."""
        this = self.as_set()
        return this._with(this.df.orderBy(*this._order(keys)), ordered=True)

    def take(self, n: int) -> Relation:
        """The first n rows of an array, or any n of a relation; an array either way."""
        this = self if self.ordered else self.as_set()
        return this._with(this.df.limit(n), ordered=True)

    def order_columns(self, names: Sequence[str]) -> Relation:
        """An array with these attributes in this order, duplicates kept."""
        this = self if self.ordered else self.as_set()
        return this._with(this.df.select(*map(column, this._need(names))), ordered=True, distinct=False, keys=())

    def rotate(self) -> Relation:
        """For display: one block of attributes for each row."""
        return self._with(self.df, ordered=True, vertical=True)

    # -- text

    def split(self, name: str, pattern: str, new: Sequence[str] | None = None) -> Relation:
        """One row for each piece of a text attribute; new: its name, and one for the place."""
        this = self.as_set()
        this._need([name])
        if not isinstance(this.types[name], T.StringType):
            raise QueryError(f"{name} is {type_name(this.types[name])}; only text can be split")
        new = list(new or [name])
        if len(new) > 2 or len(set(new)) < len(new):
            raise QueryError("a split gives a piece and at most a place")
        kept = [n for n in this.df.columns if n != name]
        for n in new:
            if n in kept:
                raise QueryError(f"attribute {n!r} is there already")
        pieces = patterns.pieces(column(name), pattern)
        at = f"_at{next(FRESH)}"
        df = this.df.select(*map(column, kept), F.posexplode(pieces).alias(at, new[0]))
        if len(new) == 2:
            safe = any(k <= set(kept) for k in this.keys)
            df = df.select(*map(column, kept), column(new[0]), (column(at) + 1).cast(INT).alias(new[1]))
            keys = tuple(k | {new[1]} for k in this._kept_keys(set(kept)))
            return this._with(df if safe else df.distinct(), keys=keys if safe else (), distinct=True)
        return this._with(df.drop(at).distinct(), keys=(), distinct=True)

    # -- schema

    def apply_schema(self, schema: Relation | dict[str, str]) -> Relation:
        """Strict casts to declared types. schema: a relation {attr type}, small by nature, or a dict."""
        this = self.as_set()
        if isinstance(schema, Relation):
            if schema.heading != {"attr", "type"}:
                raise QueryError("a schema has the attributes attr and type")
            schema = {r["attr"]: r["type"] for r in schema.df.select("attr", "type").collect()}
        this._need(schema)
        cols = []
        for n in this.df.columns:
            v = Value(column(n), this.types[n])
            if n in schema:
                v = strict(v, self._type(schema[n]))
            cols.append(v.col.alias(n))
        df = this.df.select(*cols)
        keys = tuple(k for k in this.keys if not k & set(schema))
        known = {n: type_name(t) for n, t in this.types.items()} | (this.declared or {})
        out = this._with(df if keys else df.distinct(), keys=keys, distinct=True, declared=known | schema)
        guards = [n for n, t in schema.items() if not isinstance(self._type(t), T.StringType)]
        if guards:  # a cast that fails must fail even if its attribute is not read
            out.df = out.df.where(_all_present(guards))
        return out._enforced({n: t for n, t in schema.items()})

    def _type(self, name: str) -> T.DataType:
        return self.session.resolve_type(name) if self.session else spark_type(name)

    def _enforced(self, declared: dict[str, str] | None) -> Relation:
        """The rows, with an error for values outside the relations that ``in(R, a)`` types name."""
        out = self
        for name, kind in (declared or {}).items():
            place = self.session.reference(kind) if self.session else None
            if place is None:
                continue
            relation, attr = place
            own, mark = f"_ref{next(FRESH)}", f"_mark{next(FRESH)}"
            a, b = meeting(
                Value(column(name), out.types[name]), Value(column(attr), relation.types[attr])
            )
            right = relation.df.select(b.col.alias(own)).distinct().withColumn(mark, F.lit(True))
            left = f"_left{next(FRESH)}"
            joined = out.df.withColumn(left, a.col).join(right, column(left) == column(own), "left")
            bad = F.raise_error(F.concat(F.lit(f"{name}: "), column(name).cast(STR), F.lit(f" is not {kind}")))
            kept = joined.where(F.when(column(mark).isNull(), bad.cast("boolean")).otherwise(F.lit(True)))
            out = out._with(kept.drop(own, mark, left))
        return out

    def extract_schema(self) -> Relation:
        """attr, type: the attributes with their declared, or else actual, types."""
        known = {n: type_name(t) for n, t in self.types.items()} | (self.declared or {})
        rows = [(n, known[n]) for n in sorted(self.heading)]
        df = self.spark.createDataFrame(rows, "attr string, type string")
        return Relation(df, keys=(frozenset(["attr"]),), session=self.session)

    def describe(self, full: bool = False) -> Relation:
        from quillon.operators.describe import described

        return described(self.as_set(), full)


def _all_present(names: list[str]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & column(n).isNotNull()
    return test


def _numeric(relation: Relation, name: str) -> Column:
    from quillon.functions.values import number

    return number(Value(column(name), relation.types[name])).col


def _to(v: Value, kind: T.DataType) -> Column:
    """A value in another column's type; what does not fit is an error when it is read."""
    if v.type == kind:
        return v.col
    return strict(v, kind).col if not is_nested(kind) else v.col.cast(kind)


def _coerced_join(a: Relation, b: Relation, shared: list[str], how: str, also: Sequence[str] = ()) -> DataFrame:
    """a's columns, b's other columns, and b's shared ones as ``_r_name``. Keys of unlike types
    meet in a common one, so the join stays an equality that can be hashed or sorted."""
    right = b.df.select(*[column(n).alias(f"_r_{n}") if n in shared else column(n) for n in b.df.columns])
    test = None
    for n in shared:
        x, y = meeting(Value(column(n), a.types[n]), Value(column(f"_r_{n}"), b.types[n]))
        test = (x.col == y.col) if test is None else test & (x.col == y.col)
    return a.df.join(right, test, how)

