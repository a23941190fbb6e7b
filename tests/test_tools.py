"""CSV, workspaces, display, scripts, the command line and streams."""

import re

import pytest

from quillon import cli, display
from quillon.functions.values import QueryError
from quillon.operators.relation import Relation
from quillon.session import Session
from quillon.sources import tables, workspace
from quillon.streaming import chains


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_types(spark, tmp_path):
    path = write(tmp_path, "a.csv", " name ,n,price,ok,gap\nAlice,1,1.50,true,\nBob,2,0.75,False,3\nBob\n")
    found = tables.csv(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in found.df.schema}
    assert kinds == {"name": "string", "n": "bigint", "price": "decimal(38,2)", "ok": "boolean", "gap": "string"}
    assert found.as_set().df.count() == 2


def test_csv_dedupes_but_for_keys(spark, tmp_path):
    path = write(tmp_path, "b.csv", "v\n1\n1\n2\n")
    assert tables.csv(spark, path).as_set().df.count() == 2
    keyed = tables.csv(spark, path, {"id": "key"})
    assert sorted(r["id"] for r in keyed.as_set().df.collect()) == [1, 2, 3]
    hashed = tables.csv(spark, path, {"h": "hash"}).as_set().df.collect()
    assert len(hashed) == 2 and all(len(r["h"]) == 16 for r in hashed)
    assert tables.csv(spark, path, {"u": "uuid"}).as_set().df.count() == 3
    with pytest.raises(QueryError):
        tables.csv(spark, path, {"v": "key"})


def test_csv_without_rows(spark, tmp_path):
    assert tables.csv(spark, write(tmp_path, "c.csv", "a,b\n")).heading == {"a", "b"}


def test_workspace_round_trip(spark, sample, tmp_path):
    sample.run("nested := E *: phones: Phone")
    sample.run('typed := D :: {attr type; "dept_name" "str"}')
    workspace.save(sample, str(tmp_path / "w"))
    other = Session(spark)
    assert set(workspace.load(other, str(tmp_path / "w"))) == set(sample.relations)
    assert other.run("nested <: phones").as_set().df.count() == 3
    assert other.relations["typed"].declared == sample.relations["typed"].declared


def test_display(sample):
    assert display.table(sample.run("D")) == (
        "+---------+-------------+\n| dept_id | dept_name   |\n+---------+-------------+\n"
        "| 10      | Engineering |\n| 20      | Sales       |\n+---------+-------------+"
    )
    assert display.table(sample.run('D ? dept_id = 10 r.')).splitlines()[0] == "dept_id   : 10"
    assert display.as_csv(sample.run("D $ dept_id-")) == "dept_id,dept_name\n20,Sales\n10,Engineering\n"
    nested = display.table(sample.run('E ? name = "Alice" *: p: Phone # p'))
    assert '{(phone: "555-1234")}' in nested


def test_csv_written_by_executors(spark, sample, tmp_path):
    display.write_csv(sample.run("E # name"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_substitution_and_continuation():
    assert cli.substituted("? x > {{a}} & y = {{b:2}}", {"a": "1"}) == "? x > 1 & y = 2"
    with pytest.raises(QueryError):
        cli.substituted("{{a}}", {})
    assert cli.joined("a \\\nb\nc") == ["a  b", "c"]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["--sample", "--csv", "-e", "E # name $ name ^ 2"], spark) == 0
    assert capsys.readouterr().out == "name\nAlice\nBob\n"
    helper = write(tmp_path, "h.qn", "top := fn $ salary- ^ 1\n")
    script = write(tmp_path, "s.qn", f"# a comment\n\\include {helper}\nhigh := E ? salary > {{{{least}}}}\nhigh # [name salary] top\n")
    assert cli.main(["--sample", "--no-header", "-f", script, "--arg", "least=50000"], spark) == 0
    assert capsys.readouterr().out == "Dave,90000\n"
    data = write(tmp_path, "d.csv", "a,b\n1,x\n2,y\n")
    assert cli.main([f"t={data}", "--genkey", "--csv", "-e", "t /. [n: #. m: >. t_id]"], spark) == 0
    assert capsys.readouterr().out == "m,n\n2,2\n"
    assert cli.main(["-e", "Nothing"], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["-e", "E", "-f", script], spark)


def test_shell_commands(sample, tmp_path):
    shell = cli.Shell(sample)
    assert "dept_name" in shell.line("\\env")
    shell.line("f := fn # name")
    assert shell.line("\\fn f") == "f := fn # name"
    shell.line(f"\\export {tmp_path}/o.csv E # name")
    assert (tmp_path / "o.csv").read_text().splitlines()[0] == "name"
    shell.line(f"\\load {tmp_path}/o.csv again +key=id")
    assert shell.line("again").as_set().df.count() == 5
    shell.line(f"\\save {tmp_path}/ws")
    shell.line("\\drop E")
    with pytest.raises(QueryError):
        shell.line("E")
    shell.line(f"\\load {tmp_path}/ws")
    assert shell.line("E").df.count() == 5
    loop = write(tmp_path, "loop.qn", f"\\include {tmp_path}/loop.qn\n")
    with pytest.raises(QueryError):
        shell.include(loop)


def test_lines_read_by_the_driver(sample):
    cli.Shell(sample).load_lines(["a,b", "1,x", "2,y", "2,y", "bad"], "stdin")
    assert sample.run("stdin").as_set().df.count() == 2


def test_rowwise_chain_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (5, "b")], "n long, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, s string").parquet(str(tmp_path / "in"))
    out = chains.rowwise(stream, [("where", "n > 2"), ("extend", {"twice": "n * 2"})])
    query = out.writeStream.format("memory").queryName("rowwise").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("rowwise").collect()] == [(5, "b", 10)]
    with pytest.raises(QueryError):
        chains.rowwise(stream, [("rank", None)])


def test_windowed_summary_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a", 1), ("2024-01-01 00:00:50", "a", 2), ("2024-01-01 01:00:00", "a", 3)]
    df = spark.createDataFrame(rows, "t string, k string, v long").selectExpr("cast(t as timestamp) t", "k", "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = chains.windowed(stream, "t", "1 minute", "10 minutes", ["k"], {"n": "#.", "total": "+. v"})
    query = out.writeStream.format("memory").outputMode("complete").queryName("windowed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.table("windowed").collect()) == [(1, 3), (2, 3)]


def test_csv_dialect(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('a, b ,a,c,d\n1,"say ""hi"", x",5,"end\\",0.12345678901234567890123\n2,"x\ny",6,,1.5\nshort\n')
    df = tables.csv(spark, str(path)).as_set().df
    assert df.columns == ["a", "b", "c", "d"]
    found = sorted((r.a, r.b, r.c, r.d) for r in df.collect())
    assert found == [(5, 'say "hi", x', "end\\", "0.12345678901234567890123"), (6, "x\ny", "", "1.5")]


def test_csv_of_many_digits_and_no_rows(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("n,m\n123456789012345678901234567890,0000000000000000000000000000000000000000007.25\n")
    row = tables.csv(spark, str(path)).as_set().df.first()
    assert str(row.n) == "123456789012345678901234567890" and str(row.m) == "7.25"
    path.write_text("")
    assert tables.csv(spark, str(path)).df.columns == []


def test_made_columns_are_stable(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("v\n" + "".join(f"{i % 7}\n" for i in range(500)))
    keyed = tables.csv(spark, str(path), {"id": "key"}).df
    assert sorted((r.id, r.v) for r in keyed.collect()) == [(i + 1, i % 7) for i in range(500)]
    marked = tables.csv(spark, str(path), {"u": "uuid"}).df
    once, again = (sorted(r.u for r in marked.collect()) for _ in range(2))
    assert once == again and len(set(once)) == 500
    assert all(re.fullmatch("[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}", u) for u in once)


def test_standard_input_has_the_same_dialect(sample):
    cli.Shell(sample).load_lines(['a,b\n', '1,"x,\n', 'y ""z"""\n'], "odd")
    assert [(r.a, r.b) for r in sample.relations["odd"].df.collect()] == [(1, 'x,\ny "z"')]


def test_tables_say_when_rows_are_left_out(spark):
    relation = Relation.bind(spark.range(30).toDF("n"), trusted=True)
    assert "more than 10 rows" in display.table(relation, 10) and "more than" not in display.table(relation, 30)
