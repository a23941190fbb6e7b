"""Operators on the sample relations."""

from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions.values import QueryError
from quillon.lang.lexer import SyntaxProblem

#: What a query that fails while it runs raises.
FAILS = (PySparkException, Py4JJavaError)


def names(found):
    return sorted(r[0] for r in found)


def test_filter_and_project(rows):
    assert names(rows("E ? salary > 50000 # name")) == ["Alice", "Bob", "Carol", "Dave"]
    assert rows("E # role") == [("engineer",), ("manager",)]
    assert rows("E #! [emp_id name salary dept_id]") == [("engineer",), ("manager",)]


def test_negated_filter_is_the_complement(rows):
    assert names(rows("E ?! (dept_id = 20 | salary > 70000) # name")) == ["Bob"]
    assert len(rows("E ? salary > 60000")) + len(rows("E ?! salary > 60000")) == 5


def test_groups_of_conditions_go_from_left_to_right(rows):
    found = rows('E ? (dept_id = 20 | dept_id = 10 & role = "manager") # name')
    assert names(found) == ["Bob"]


def test_arithmetic_has_one_precedence(rows):
    assert rows('E ? name = "Bob" +: x: salary + 1 * 2 # x') == [(120002,)]
    assert rows("i. n: 3 +: x: n * -1 // 2 # x") == [(-1,), (-2,)]


def test_floor_and_remainder_follow_the_divisor(rows):
    found = rows("i. n: 4 +: [f: n - 2 // -3 r: n - 2 % -3 q: n - 2 // 3 m: n - 2 % 3] #! n")
    want = {((n - 2) // -3, (n - 2) // 3, (n - 2) % -3, (n - 2) % 3) for n in range(1, 5)}
    assert {(f, q, r, m) for f, m, q, r in found} == want


def test_division_by_zero_is_an_error(rows):
    with pytest.raises(FAILS):
        rows("i. n: 1 +: x: n / 0")


def test_rename_may_swap(rows):
    assert ("Alice", 80000) in [(r[4], r[2]) for r in rows("E @ [name salary salary name]")]
    with pytest.raises(QueryError):
        rows("E @ [name salary]")
    with pytest.raises(QueryError):
        rows("E @ [nothing x]")


def test_extend_sees_the_row_as_it_was(rows):
    assert rows('D +: [a: dept_id + 1 b: dept_id + 2] ? dept_id = 10 # [a b]') == [(11, 12)]
    with pytest.raises(QueryError):
        rows("E +: name: salary")


def test_modify_dedupes(rows):
    assert rows("E # [salary dept_id] =: salary: 0") == [(10, 0), (20, 0)]
    with pytest.raises(QueryError):
        rows("E =: nothing: 1")


def test_natural_join(rows):
    assert len(rows("E *. Phone")) == 3
    assert len(rows("E *. D")) == 5
    assert len(rows("D *. ContractorPay")) == 2
    assert rows("E *. (E ? salary > 80000) # name") == [("Dave",)]


def test_left_join_defaults(rows):
    assert len(rows('E *< Phone [phone: "none"]')) == 6
    assert names(rows('E *< Phone [phone: "none"] ? phone = "none" # name')) == ["Bob", "Dave", "Eve"]
    with pytest.raises(FAILS):
        rows("E *< Phone # name")
    assert len(rows("Phone *< E")) == 3


def test_joins_of_text_with_numbers(rows):
    found = rows('{emp_id tag; "1" "x"; "2.0" "y"; "z" "w"} *. E # [name tag]')
    assert found == [("Alice", "x"), ("Bob", "y")]
    assert rows('{k a; "1" "p"} *. {k b; "1.0" "q"}') == []


def test_nest_join_and_unnest(rows):
    assert names(rows("E *: phones: Phone ? #. phones = 0 # name")) == ["Bob", "Dave", "Eve"]
    assert rows("E *: phones: Phone <: phones") == rows("E *. Phone")
    assert rows("D *: all: ContractorPay +: n: #. all # n") == [(1,)]


def test_nest_by_and_back(rows):
    assert rows("E /: team: dept_id <: team") == rows("E")
    found = rows('E /: team: dept_id +: [n: #. (team ? role = "engineer") top: >. team.salary] #! team')
    assert found == [(10, 2, 90000), (20, 2, 55000)]


def test_summaries(rows):
    assert rows("E /. [n: #. total: +. salary]") == [(5, 330000)]
    assert rows("E /. dept_id [n: #.]") == [(10, 3), (20, 2)]
    assert rows("E /. dept_id [#. +. salary] # [count sum_salary]") == [(2, 100000), (3, 230000)]
    assert rows("E ? salary < 0 /. [n: #. s: +. salary]") == [(0, 0)]
    assert rows("E ? salary < 0 /. dept_id [n: #.]") == []
    with pytest.raises(FAILS):
        rows("E ? salary < 0 /. [m: >. salary]")
    with pytest.raises(QueryError):
        rows("E /. nothing [n: #.]")
    with pytest.raises(SyntaxProblem):
        rows("E /. [#. #.]")


def test_percent_and_aggregate_arithmetic(rows):
    assert rows("E /. dept_id [p: p. salary ~ 1]") == [(10, Decimal("69.7")), (20, Decimal("30.3"))]
    assert rows("E /. dept_id [m: (+. salary / #.) ~ 0]") == [(10, Decimal(76667)), (20, Decimal(50000))]


def test_broadcast_aggregates(rows):
    assert names(rows("E /* dept_id [top: >. salary] ? salary = top # name")) == ["Carol", "Dave"]
    assert {r[-1] for r in rows("E /* [zz: #.]")} == {5}
    with pytest.raises(QueryError):
        rows("E /* nothing [n: #.]")


def test_collect_and_nested_rows_compare_as_sets(rows):
    found = rows("E /. dept_id [members: n. role] # members")
    assert sorted(len(r[0]) for r in found) == [1, 2]
    assert len(rows("{a b; 1 1; 1 2; 2 2; 2 1} /: s: a # s")) == 1


def test_rank_and_bucket(rows):
    ties = '{n v; "a" 10; "b" 20; "c" 20; "d" 30}'
    assert [r[1] for r in rows(f"{ties} /^ r: v #! v")] == [1, 2, 2, 3]
    assert rows("E /^ r: [dept_id salary-] ? r = 1 # name") == [("Dave",)]
    assert sorted(r[0] for r in rows("i. v: 10 /& b: v 3")) == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert rows("{id s; 1 100; 2 100; 3 80; 4 80; 5 50} /& b: s- 3 # [id b]") == [
        (1, 1), (1, 2), (2, 3), (2, 4), (3, 5),
    ]


def test_sort_take_and_the_array_border(rows):
    assert [r[0] for r in rows("E # [name salary] $ salary- ^ 2")] == ["Dave", "Alice"]
    assert len(rows("E $. role")) == 5
    for text in ("E $ name # name", "E ^ 2 ? salary > 1", "x := E $ name"):
        with pytest.raises(QueryError):
            rows(text)


def test_set_operators(rows):
    a, b = "(E ? dept_id = 10 # name)", "(E ? salary < 70000 # name)"
    assert names(rows(f"{a} |. {b}")) == ["Alice", "Bob", "Carol", "Dave", "Eve"]
    assert names(rows(f"{a} -. {b}")) == ["Alice", "Dave"]
    assert names(rows(f"{a} &. {b}")) == ["Bob"]
    assert rows(f"{a} -. ({a} -. {b})") == rows(f"{a} &. {b}")
    with pytest.raises(QueryError):
        rows("E |. D")


def test_set_operators_take_the_left_types(rows):
    assert rows('{x y; 1 "a"} |. {y x; "b" "2"}') == [(1, "a"), (2, "b")]


def test_membership_and_subqueries(rows):
    assert names(rows("E ? emp_id in. (Phone # emp_id) # name")) == ["Alice", "Carol"]
    assert names(rows("E ?! emp_id in. (Phone # emp_id) # name")) == ["Bob", "Dave", "Eve"]
    assert names(rows("E ? salary > (E /. [m: %. salary]) # name")) == ["Alice", "Dave"]
    assert names(rows("E ? emp_id = (Phone # emp_id) # name")) == ["Alice", "Carol"]
    assert names(rows("E ? emp_id != (Phone # emp_id) # name")) == ["Bob", "Dave", "Eve"]
    assert names(rows('E ? (emp_id in. (Phone # emp_id) | role = "manager") # name')) == ["Alice", "Bob", "Carol"]
    with pytest.raises(FAILS):
        rows("E ? salary > (E # salary) # name")
    with pytest.raises(QueryError):
        rows("E ? emp_id in. Phone")


def test_set_literals_and_patterns(rows):
    assert names(rows("E ? dept_id = {20, 30} # name")) == ["Carol", "Eve"]
    assert names(rows('E ? name != {"Bob" "Eve"} # name')) == ["Alice", "Carol", "Dave"]
    assert names(rows('E ? name =~ "^[A-C]" # name')) == ["Alice", "Bob", "Carol"]
    assert names(rows('E ? name !=~ "e$" # name')) == ["Bob", "Carol"]
    with pytest.raises(QueryError):
        rows('E ? name =~ "["')
    with pytest.raises(SyntaxProblem):
        rows("E ? dept_id > {1}")


def test_text_that_reads_as_a_number(rows):
    assert rows('{c; "007"; "8"; "x"} ? c = "7"') == [("007",)]
    assert rows('{c; "10"; "9"; "x"} ? c > 9') == [("10",)]
    assert rows('{c; "10"; "20"; "30"} /. [t: +. c]') == [(Decimal(60),)]


def test_strings(rows):
    one = '{s; "héllo wörld"}'
    assert rows(f'{one} +: [a: s .s [1 3] b: s .s [-3] c: s .s [0 2] d: s .s "upper" e: s .s "title"] #! s') == [
        ("hél", "rld", "", "HÉLLO WÖRLD", "Héllo Wörld")
    ]
    assert rows('{s; " a b "} +: [t: s .s "trim" n: s .s "len" l: s .s "ltrim"] #! s') == [("a b ", 5, "a b")]
    assert rows('{s; "o\'neil"} =: s: s .s "title"') == [("O'Neil",)]
    assert rows('{s; "a1b22"} =: s: s .r "([0-9]+)" "<\\\\1$>"') == [("a<1$>b<22$>",)]
    with pytest.raises(QueryError):
        rows(f'{one} +: x: s .s "nothing"')


def test_literals_keep_their_values(sample, rows):
    row = "9007199254740993 1 \"o'\\\"\u00e9`\" true"
    found = rows(f'{{n x s b; {row}; {row}; -1 2.5 "" false}}')
    assert found == [(False, -1, "", 2.5), (True, 9007199254740993, "o'\"\u00e9`", 1.0)]
    assert dict(sample.run("{a b}").df.dtypes) == {"a": "string", "b": "string"} and rows("{a b}") == []
    with pytest.raises(QueryError):
        rows("{n; 99999999999999999999}")


def test_format(rows):
    found = rows('{n x s; 7 1234.5 "ab"} +: t: "{n:03d}|{x:,.2f}|{s:>4}|{s:<4}|{s:^4}|{n}|{x:.1%}" .f # t')
    assert found == [("007|1,234.50|  ab|ab  | ab |7|123450.0%",)]


def test_dates(rows):
    one = '{s; "2024-02-29"} +: d: s .d'
    found = rows(f'{one} +: [w: d .d "week" o: d .d "dow" q: d .d "qq" t: d .d "{{d}}.{{m}}.{{yy}} {{ddd}} {{mmm}}"] #! [s d]')
    assert found == [(4, "Q1", "29.2.24 THU FEB", 9)]
    assert rows(f'{one} +: [n: "2024-03-01" .d - d] # n') == [(1,)]
    assert str(rows(f"{one} +: x: d + 1 # x")[0][0]) == "2024-03-01"
    assert rows(f'{one} ? d > "2024-01-01" # s') == [("2024-02-29",)]
    with pytest.raises(FAILS):
        rows('{s; "2024-13-01"} +: d: s .d')


def test_ternary(rows):
    found = rows('E +: k: ?: dept_id = 10 "eng" (?: salary > 50000 "mid" "low") # [k name]')
    assert dict((n, k) for k, n in found) == {"Alice": "eng", "Bob": "eng", "Carol": "mid", "Dave": "eng", "Eve": "low"}


def test_split(rows):
    tags = '{id tags; 1 "a,b"; 2 "d"; 3 "a,,a"; 4 ""}'
    assert rows(f'{tags} /> tags ","') == [(1, "a"), (1, "b"), (2, "d"), (3, ""), (3, "a"), (4, "")]
    assert rows(f'{tags} /> [t at]: tags "," ? id = 3 #! id') == [(1, "a"), (2, ""), (3, "a")]
    assert rows(f'{tags} #! id /> t: tags "," ') == [("",), ("a",), ("b",), ("d",)]
    assert rows('{t; "1-2--3"} /> [p at]: t "(-)(-)?" $ at') == [("1", 1), ("-", 2), ("", 3), ("2", 4), ("-", 5), ("-", 6), ("3", 7)]
    for bad in ('E /> salary ","', 'Phone /> emp_id: phone "-"'):
        with pytest.raises(QueryError):
            rows(bad)


def test_sources(rows):
    assert rows("i. 3") == [(1,), (2,), (3,)]
    assert rows("I. k: (D /. [n: #.])") == [(0,), (1,)]
    assert rows('{a b; 1 "x"; 1 "x"; -2 "y";}') == [(-2, "y"), (1, "x")]
    assert rows("{a b}") == []
    assert rows("{a; (E /. [m: >. salary])}") == [(90000,)]
    for bad in ("i. 0", "Nothing"):
        with pytest.raises(QueryError):
            rows(bad)
    with pytest.raises(SyntaxProblem):
        rows("{a b; 1}")


def test_schema(rows, sample):
    typed = rows('{n s; "a" "10"; "b" "9"} :: {attr type; "s" "int"} /^ r: s')
    assert typed == [("a", 2, 10), ("b", 1, 9)]
    assert rows("D ::") == [("dept_id", "int"), ("dept_name", "str")]
    with pytest.raises(FAILS):
        rows('{s; "x"} :: {attr type; "s" "int"} # s')
    with pytest.raises(FAILS):
        sample.run('{s t; "x" 1} :: {attr type; "s" "int"} # t').df.count()
    for bad in ('D :: {attr type; "x" "int"}', 'D :: {attr type; "dept_id" "what"}'):
        with pytest.raises(QueryError):
            rows(bad)


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [
        ('"3.0"', "int", 3), ('"42"', "int", 42), ("3.5", "int", None), ('"x"', "float", None), ('"2.5"', "float", 2.5),
        ("2.345", "decimal2", Decimal("2.35")), ('"TRUE"', "bool", True), ('"y"', "bool", None), ("7", "str", "7"),
        ("2.0", "str", "2.0"), ('"2024-1-1"', "date", None),
    ],
)
def test_strict_casts(rows, sample, value, kind, want):
    sample.run("decimal2 := type decimal(2)")
    if want is None:
        with pytest.raises(FAILS):
            rows(f"{{v; {value}}} +: c: v .as {kind} # c")
    else:
        assert rows(f"{{v; {value}}} +: c: v .as {kind} # c") == [(want,)]


def test_references(rows, sample):
    sample.run("Dept := type in(D, dept_id)")
    assert len(rows('E :: {attr type; "dept_id" "Dept"}')) == 5
    with pytest.raises(FAILS):
        rows('{dept_id; 10; 99} :: {attr type; "dept_id" "Dept"}')
    with pytest.raises(QueryError):
        sample.run("Loop := type Loop")


def test_declared_types_are_kept(rows):
    with pytest.raises(QueryError):
        rows('{s; "1"} :: {attr type; "s" "int"} =: s: "x"')
    assert rows('{s; "1"} :: {attr type; "s" "int"} =: s: s .as str') == [("1",)]


def test_describe(rows):
    found = {r[0]: r for r in rows('{a b c d; 1 "2024-01-01" "true" "x"; 0 "2024-05-01" "" "y"} ?.')}
    assert [found[k][3] for k in "abcd"] == ["bool", "date", "bool", "str"]
    assert found["c"][2] == 1  # empty cells
    full = rows('{d; "x"; "y"} ?. "full"')
    assert full == [("d", 2, 0, "str", "y", "x", 100, "x", "str")]


def test_functions(rows, sample):
    sample.run('engineers := fn ? role = "engineer"')
    sample.run("pay := fn # [name salary]")
    assert len(rows("E engineers pay")) == 4
    sample.register("two", lambda r: r.where("dept_id = 20"))
    assert len(rows("E two engineers")) == 2
    sample.run("loop := fn loop")
    for bad in ("E loop", "E nothing"):
        with pytest.raises(QueryError):
            rows(bad)
    with pytest.raises(SyntaxProblem):
        sample.run("empty := fn")


def test_relation_aggregates_in_a_row(rows):
    assert rows("D +: [n: #. E total: +. E.salary] # [n total]") == [(5, 330000)]


def test_fluent_methods(sample):
    e, d = sample.relations["E"], sample.relations["D"]
    found = e.natural_join(d).where("salary > 50000").summarize(["dept_name"], {"n": "#."}).sort([("n", True)])
    assert [tuple(r) for r in found.df.collect()] == [("Engineering", 3), ("Sales", 1)]
    assert e.semi_join(sample.relations["Phone"]).df.count() == 2
    assert e.anti_join(sample.relations["Phone"]).df.count() == 3


def test_ranks_do_not_depend_on_exchange_reuse(spark):
    """Distinct keys over many ranges, with the plan's shared exchanges not shared."""
    from quillon.operators.relation import Relation

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        n = 500_000
        df = spark.range(n).selectExpr("id", "(id * 7919) % 1000003 AS k")
        ranked = Relation.bind(df, trusted=True).rank("r", [("k", True)])
        top, most, distinct = ranked.df.selectExpr("max(r)", "count(*)", "count(distinct r)").first()
        assert (top, most, distinct) == (n, n, n)
        first = ranked.df.orderBy("r").limit(3).collect()
        assert [r.r for r in first] == [1, 2, 3] and first[0].k > first[1].k > first[2].k
        bucketed = Relation.bind(df.where("id < 1000"), trusted=True).bucket("b", [("k", False)], 4)
        assert [r["count"] for r in bucketed.df.groupBy("b").count().orderBy("b").collect()] == [250] * 4
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize(
    ("spec", "value"),
    [(".2f", 0.125), (".2f", 2.675), (".0f", 0.5), ("+.1f", -0.25), (",.2f", 1234567.125), ("08.3f", -1.0005), (".1%", 0.0625), ("*^12.2f", 8.005)],
)
def test_formats_round_as_python_does(spark, spec, value):
    from quillon.functions import patterns
    from quillon.functions.values import FLOAT, Value

    col = patterns.formatted(Value(F.col("x"), FLOAT), spec)
    assert spark.createDataFrame([(value,)], "x double").select(col.alias("s")).first().s == format(value, spec)


@pytest.mark.parametrize("places", [0, 2, 3, 9, 15])
def test_formats_round_exact_values(spark, places):
    """Halfway texts and the doubles beside them, from the smallest sizes to the most digits a double holds."""
    import math

    from quillon.functions import patterns
    from quillon.functions.values import FLOAT, Value

    halfway = [(n * 10 + 5) / 10 ** (places + 1) for k in range(16) for n in (0, 1, 2, 7 * 10**k + 3, 10**k + 4)]
    values = [x for h in halfway for x in (h, math.nextafter(h, 0), math.nextafter(h, math.inf)) if x * 10.0**places < 9e15]
    df = spark.createDataFrame([(x,) for x in [*values, 0.0, -0.125, 5e-324]], "x double")
    found = df.select("x", patterns.formatted(Value(F.col("x"), FLOAT), f".{places}f").alias("s")).collect()
    assert [r.s for r in found] == [format(r.x, f".{places}f") for r in found]


def test_formats_stay_small_trees(spark):
    """A number's text is used several times over; written out, it was 150 KB for seven numbers."""
    from quillon.functions import patterns
    from quillon.functions.values import FLOAT, Value

    df = spark.range(1).selectExpr("id * 1.5D AS x").select(patterns.formatted(Value(F.col("x"), FLOAT), "^+16,.3f").alias("s"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 40_000
