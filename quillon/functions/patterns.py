"""Python's regular expressions, format strings and date patterns, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.values import INT, STR, QueryError, Value, date, is_number, number, text

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DAYS = "MON TUE WED THU FRI SAT SUN".split()


def java(pattern: str) -> str:
    """The pattern in Java's dialect. A bad pattern fails here, before anything runs."""
    try:
        re.compile(pattern)
    except re.error as problem:
        raise QueryError(f"bad pattern {pattern!r}: {problem}") from problem
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\\k<{m[1].replace('_', '')}>", out)
    return "(?U)" + out.replace(r"\Z", r"\z")


def java_column(pattern: Column) -> Column:
    """The same for patterns that are only known row by row."""
    for name, new in ((r"\(\?P<(\w+)>", r"(?<$1>"), (r"\(\?P=(\w+)\)", r"\\k<$1>"), (r"\\Z", r"\\z")):
        pattern = F.regexp_replace(pattern, F.lit(name), F.lit(new))
    return F.concat(F.lit("(?U)"), pattern)


REFERENCE = re.compile(r"\\g<(\w+)>|\\(\d{1,2})|\\\\|([$\\])")


def java_replacement(replacement: str) -> str:
    """A replacement of re.sub: references to groups become Java's, a dollar stays a dollar."""

    def new(found: re.Match) -> str:
        group = found[1] or found[2]
        if group is None:
            return "\\" + (found[3] or "\\")
        if not group.isdigit():
            return "${" + group.replace("_", "") + "}"
        # Java takes the digits that follow for a part of the number.
        after = found.string[found.end() : found.end() + 1]
        return f"${int(group)}" + ("\\" if after.isdigit() else "")

    return REFERENCE.sub(new, replacement)


def pieces(s: Column, pattern: str) -> Column:
    """The pieces of a text, and between them what each group of the pattern matched; empty text
    where a group took no part."""
    groups = re.compile(pattern).groups if java(pattern) else 0
    gaps = F.split(s, java(pattern), -1)
    if not groups:
        return gaps
    hits = [F.regexp_extract_all(s, F.lit(java(pattern)), F.lit(k + 1)) for k in range(groups)]
    both = F.struct(gaps.alias("gaps"), *[h.alias(f"h{k}") for k, h in enumerate(hits)])

    def mixed(all_: Column) -> Column:
        at = lambda i: F.array(*[F.get(all_[f"h{k}"], i) for k in range(groups)])
        last = F.size(all_["gaps"]) - 1
        return F.flatten(F.transform(all_["gaps"], lambda gap, i: F.when(i == last, F.array(gap)).otherwise(F.concat(F.array(gap), at(i)))))

    return F.get(F.transform(F.array(both), mixed), F.lit(0))


def keyword(v: Value, word: str) -> Value:
    """One of the named string operations."""
    s = text(v)
    edge = r"(?U)[\s\x1c-\x1f]+"
    ways = {
        "upper": lambda: F.upper(s),
        "lower": lambda: F.lower(s),
        "title": lambda: F.array_join(
            F.transform(
                F.regexp_extract_all(s, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0)),
                lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2)))),
            ),
            "",
        ),
        "cap": lambda: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2)))),
        "trim": lambda: F.regexp_replace(s, f"^{edge}|{edge}$", ""),
        "ltrim": lambda: F.regexp_replace(s, f"^{edge}", ""),
        "rtrim": lambda: F.regexp_replace(s, f"{edge}$", ""),
    }
    if word == "len":
        return Value(F.length(s).cast(INT), INT)
    if word not in ways:
        raise QueryError(f"unknown string operation {word!r} (expected {', '.join(sorted([*ways, 'len']))})")
    return Value(ways[word](), STR)


def cut(v: Value, start: int, end: int | None) -> Value:
    """Characters start to end, from 1, both included; negative places count from the end."""
    s = text(v)
    size = F.length(s)
    first = F.lit(start - 1) if start > 0 else size + start
    last = size if end is None else F.lit(end) if end > 0 else size + end + 1
    first, last = (F.greatest(F.lit(0), F.least(x, size)) for x in (first, last))
    return Value(F.substr(s, first + 1, F.greatest(F.lit(0), last - first)), STR)


def date_part(v: Value, word: str | None) -> Value:
    """A date, one of its numbers, or its text in a pattern of tokens in braces."""
    d = date(v).col
    if word is None:
        return Value(d, T.DateType())
    numbers = {
        "year": lambda: F.year(d),
        "month": lambda: F.month(d),
        "day": lambda: F.dayofmonth(d),
        "week": lambda: F.weekofyear(d),
        "dow": lambda: F.weekday(d) + 1,
        "q": lambda: F.quarter(d),
    }
    if word in numbers:
        return Value(numbers[word]().cast(INT), INT)
    if word in ("ww", "qq"):
        return Value(_date_token(d, word), STR)
    pieces = re.split(r"\{([^}]*)\}", word)
    if len(pieces) == 1:
        raise QueryError(f"unknown date operation {word!r}")
    cols = [F.lit(p) if i % 2 == 0 else _date_token(d, p) for i, p in enumerate(pieces)]
    return Value(F.concat(*cols), STR)


def _date_token(d: Column, token: str) -> Column:
    two = lambda c: F.lpad(c.cast(STR), 2, "0")
    named = lambda words, at: F.element_at(F.array(*map(F.lit, words)), at)
    tokens = {
        "d": lambda: F.dayofmonth(d).cast(STR),
        "dd": lambda: two(F.dayofmonth(d)),
        "m": lambda: F.month(d).cast(STR),
        "mm": lambda: two(F.month(d)),
        "mmm": lambda: named(MONTHS, F.month(d)),
        "yy": lambda: two(F.year(d) % 100),
        "yyyy": lambda: F.lpad(F.year(d).cast(STR), 4, "0"),
        "week": lambda: F.weekofyear(d).cast(STR),
        "ww": lambda: two(F.weekofyear(d)),
        "dow": lambda: (F.weekday(d) + 1).cast(STR),
        "ddd": lambda: named(DAYS, F.weekday(d) + 1),
        "q": lambda: F.quarter(d).cast(STR),
        "qq": lambda: F.concat(F.lit("Q"), F.quarter(d).cast(STR)),
    }
    if token not in tokens:
        raise QueryError(f"unknown date token {token!r}")
    return tokens[token]()


SPEC = re.compile(r"(?:(.)?([<>^=]))?([-+ ])?(0)?(\d+)?([,_])?(?:\.(\d+))?([bdeEfFosxX%])?")


def _digits(v: Value, places: int) -> Column:
    """A number's size as text with so many places, rounded as Python does: the exact value, ties
    to even. A double times a power of ten is a double and, exactly, what that one lacks, which
    decides where the first is halfway between two whole numbers; those with more digits than a
    double holds are rounded from their shortest form."""
    if not isinstance(v.type, T.DoubleType):
        return F.abs(F.bround(v.col.cast(T.DecimalType(38, 18)), places)).cast(T.DecimalType(38, places)).cast(STR)
    size = F.abs(v.col)
    shortest = F.format_string(f"%.{places}f", size)
    if places > 15:
        return shortest
    scaled = size * 10.0**places
    halfway = F.abs(scaled - F.rint(scaled)) == 0.5
    units = F.rint(F.when(halfway, scaled + F.signum(_lacks(size, 10.0**places)) * 0.5).otherwise(scaled)).cast("long")
    exact = units.cast(STR)
    if places:
        whole = F.call_function("div", units, F.lit(10**places))
        exact = F.concat(whole.cast(STR), F.lit("."), F.lpad((units % 10**places).cast(STR), places, "0"))
    return F.when(scaled < 9e15, exact).otherwise(shortest)


def _lacks(a: Column, b: float) -> Column:
    """What the double a * b lacks of the exact product: both are cut in halves whose products are exact."""
    cut_at = 2.0**27 + 1
    b_high = cut_at * b - (cut_at * b - b)
    b_low = b - b_high
    a_high = a * cut_at - (a * cut_at - a)
    a_low = a - a_high
    return a_high * b_high - a * b + a_high * b_low + a_low * b_high + a_low * b_low


def _grouped(digits: Column, mark: str) -> Column:
    """Thousands set apart in the part before the point."""
    head = F.regexp_extract(digits, r"^\d+", 0)
    apart = F.regexp_replace(head, r"(?<=\d)(?=(\d{3})+$)", mark)
    return F.concat(apart, F.substr(digits, F.length(head) + 1))


def formatted(v: Value, spec: str) -> Column:
    """A value in Python's format mini-language: fill, alignment, sign, zeros, width, marks between
    thousands, places and the kinds b d e E f F o s x X %."""
    found = SPEC.fullmatch(spec)
    if not found:
        raise QueryError(f"format {spec!r} is not supported")
    fill, align, sign, zeros, width, mark, places, kind = found.groups()
    sign_text = F.lit("")
    numeric = kind not in (None, "s") or mark or sign or (kind is None and is_number(v.type)) or (places and kind != "s")
    if numeric:
        v = number(v, "this format")
        if kind in ("b", "d", "o", "x", "X") and not isinstance(v.type, T.LongType):
            raise QueryError(f"format {spec!r} needs whole numbers")
        if kind is None and places:
            raise QueryError(f"format {spec!r} needs a kind, such as f")
        negative = v.col < 0
        if kind in ("e", "E"):
            body = F.format_string(f"%.{places or 6}{kind}", F.abs(v.col.cast("double")))
        elif kind in ("f", "F", "%"):
            wide = Value(v.col * 100, v.type) if kind == "%" else v
            body = F.concat(_digits(wide, int(places or 6)), F.lit("%" if kind == "%" else ""))
        elif kind in ("x", "X", "o", "b"):
            body = F.format_string(f"%{kind}", F.abs(v.col)) if kind != "b" else F.bin(F.abs(v.col))
        else:
            body = F.regexp_replace(text(v), "^-", "")
        body = _grouped(body, mark) if mark else body
        plus = {"+": "+", " ": " "}.get(sign or "", "")
        sign_text = F.when(negative, F.lit("-")).otherwise(F.lit(plus))
    else:
        body = text(v)
        if places:
            body = F.substring(body, 1, int(places))
    if not width:
        return F.concat(sign_text, body)
    size = F.greatest(F.lit(int(width)), F.length(body) + F.length(sign_text)).cast("int")
    if align == "=" or zeros and not align:
        return F.concat(sign_text, F.lpad(body, size - F.length(sign_text), F.lit(fill or ("0" if zeros else " "))))
    body = F.concat(sign_text, body)
    fill = fill or ("0" if zeros else " ")
    align = align or (">" if numeric else "<")
    if align == "^":
        left = F.floor((size - F.length(body)) / 2).cast("int")
        return F.rpad(F.lpad(body, F.length(body) + left, F.lit(fill)), size, F.lit(fill))
    return (F.lpad if align == ">" else F.rpad)(body, size, F.lit(fill))
