"""Command line, scripts and interactive sessions.

    python -m quillon [name=]file.csv ... [-e EXPR | -f SCRIPT] [--arg NAME=VALUE] [--csv] ...
"""

from __future__ import annotations

import argparse
import csv
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quillon import display
from quillon.functions.values import QueryError
from quillon.lang.lexer import SyntaxProblem
from quillon.operators.relation import Relation
from quillon.session import Session
from quillon.sources import tables, workspace

VERSION = "0.1.0"
OPERATORS = """\
sources      i. I. {...} name (expr)
relational   ? ?! # #! @ +: =: *. *< |. -. &. /. /* /^ /& /> :: ?.
nested       *: <: /: n.
display      $ $. ^ r.
aggregates   #. +. >. <. %. n. p.
expressions  + - * / // % ~ .s .d .f .r .as ?: = != < > <= >= =~ !=~ in. & |
statements   name := expr   name := fn ...   name := type ...
commands     \\load \\save \\drop \\env \\fn \\export \\include \\ops \\quit"""
PLACE = re.compile(r"\{\{(\w+)(?::([^}]*))?\}\}")


class Shell:
    """Statements and backslash commands over one session."""

    def __init__(self, session: Session, csv: bool = False, header: bool = True):
        self.session, self.csv, self.header = session, csv, header
        self.including: list[Path] = []
        self.saved_to: str | None = None

    def show(self, relation: Relation) -> str:
        return display.as_csv(relation, self.header).rstrip("\n") if self.csv else display.table(relation)

    def line(self, text: str) -> Relation | str | None:
        """One line: a relation, a message, or nothing."""
        text = text.strip()
        if not text or text.startswith(("#", "--")):
            return None
        return self.command(text) if text.startswith("\\") else self.session.run(text)

    def script(self, text: str, args: dict[str, str] | None = None) -> Relation | None:
        """Runs the lines of a script; the last value counts."""
        last = None
        for line in joined(substituted(text, args or {})):
            found = self.line(line)
            if isinstance(found, Relation):
                last = found
        return last

    def include(self, path: str) -> None:
        place = Path(path).resolve()
        if place in self.including:
            raise QueryError(f"{path} includes itself")
        self.including.append(place)
        try:
            self.script(place.read_text())
        finally:
            self.including.pop()

    def command(self, text: str) -> str | None:
        word, _, rest = text[1:].partition(" ")
        rest = rest.strip()
        names = self.session.relations
        if word == "load":
            return self._load(rest.split())
        if word == "save":
            self.saved_to = rest or self.saved_to
            if not self.saved_to:
                raise QueryError("\\save needs a folder")
            workspace.save(self.session, self.saved_to)
            return f"Saved {len(names)} relations to {self.saved_to}"
        if word == "drop":
            if rest not in names:
                raise QueryError(f"unknown relation {rest!r}")
            del names[rest]
            return f"Dropped {rest}"
        if word == "env":
            return "\n".join(f"{n}: {', '.join(sorted(names[n].heading))}" for n in sorted(names))
        if word == "fn":
            chosen = [rest] if rest else sorted(self.session.functions)
            if rest and rest not in self.session.functions:
                raise QueryError(f"unknown function {rest!r}")
            return "\n".join(f"{n} := fn {getattr(self.session.functions[n], 'body', '(Python)')}" for n in chosen)
        if word == "export":
            path, _, expr = rest.partition(" ")
            found = self.session.run(expr) if expr.strip() else None
            if found is None:
                raise QueryError("\\export needs a file and an expression")
            Path(path).write_text(display.as_csv(found))
            return f"Wrote {path}"
        if word == "include":
            self.include(rest)
            return None
        if word == "ops":
            return OPERATORS
        if word in ("quit", "q"):
            raise EOFError
        raise QueryError(f"unknown command \\{word}")

    def _load(self, words: list[str]) -> str:
        if not words:
            for name, relation in tables.sample(self.session.spark).items():
                self.session.bind(name, relation)
            return "Sample data loaded: " + ", ".join(tables.SAMPLE)
        make = {}
        for word in (w[1:] for w in words if w[0] == "+"):
            kind, _, name = word.partition("=")
            make[name or kind] = kind
        if "::" in words:
            at = words.index("::")
            words, schema = words[:at], words[at + 1]
        else:
            schema = None
        plain = [w for w in words if w[0] != "+"]
        path = plain[0]
        if path == "-":
            return self.load_lines(sys.stdin.read().splitlines(keepends=True), plain[1] if len(plain) > 1 else "stdin")
        if (Path(path) / workspace.MANIFEST).exists():
            return "Loaded: " + ", ".join(workspace.load(self.session, path))
        name = plain[1] if len(plain) > 1 else Path(path).stem
        relation = tables.csv(self.session.spark, path, make)
        if schema:
            relation.session = self.session
            relation = relation.apply_schema(self.session.relations[schema])
        self.session.bind(name, relation)
        return f"Loaded: {name}"

    def load_lines(self, lines: list[str], name: str) -> str:
        """CSV text that the driver has read, such as standard input."""
        header, *rows = csv.reader(line if line.endswith("\n") else line + "\n" for line in lines) if lines else [[]]
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(header))])
        cells = self.session.spark.createDataFrame([tuple(r) for r in rows if len(r) == len(header)], schema)
        self.session.bind(name, tables.typed(tables.headed(cells, header)))
        return f"Loaded: {name}"


def substituted(text: str, args: dict[str, str]) -> str:
    """The script with {{name}} and {{name:default}} filled in as plain text."""

    def fill(found: re.Match) -> str:
        if found[1] in args:
            return args[found[1]]
        if found[2] is None:
            raise QueryError(f"script argument {found[1]!r} is missing")
        return found[2]

    return PLACE.sub(fill, text)


def joined(text: str) -> list[str]:
    """Lines, those that end in a backslash joined with the next."""
    out, held = [], ""
    for line in text.splitlines():
        if line.rstrip().endswith("\\"):
            held += line.rstrip()[:-1] + " "
        else:
            out.append(held + line)
            held = ""
    return out + ([held] if held.strip() else [])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ask = argparse.ArgumentParser(prog="quillon", description="Relational algebra on Spark")
    ask.add_argument("files", nargs="*", metavar="[name=]file.csv")
    ask.add_argument("-e", dest="expr")
    ask.add_argument("-f", dest="script")
    ask.add_argument("--arg", action="append", default=[], metavar="NAME=VALUE")
    ask.add_argument("--init", action="append", default=[])
    ask.add_argument("--sample", "--load", action="store_true")
    ask.add_argument("--csv", action="store_true")
    ask.add_argument("--no-header", action="store_true")
    ask.add_argument("--genkey", nargs="?", const="", metavar="NAME")
    ask.add_argument("--ops", action="store_true")
    ask.add_argument("--version", action="version", version=VERSION)
    given = ask.parse_args(argv)
    if given.ops:
        print(OPERATORS)
        return 0
    if given.expr and given.script:
        ask.error("-e and -f exclude each other")
    if given.arg and not given.script:
        ask.error("--arg needs -f")
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    shell = Shell(Session(spark), given.csv or given.no_header, not given.no_header)
    try:
        if given.sample:
            shell.command("\\load")
        for file in given.files:
            name, _, path = file.rpartition("=")
            stem = name or Path(path).stem
            if path == "-":
                shell.load_lines(sys.stdin.read().splitlines(keepends=True), name or "stdin")
            else:
                make = {} if given.genkey is None else {given.genkey or f"{stem}_id": "key"}
                shell.session.bind(stem, tables.csv(spark, path, make))
        for path in given.init:
            shell.include(path)
        if given.expr:
            found = shell.line(given.expr.replace("\\!", "!"))
            if found is not None:
                print(shell.show(found) if isinstance(found, Relation) else found)
        elif given.script:
            args = dict(a.split("=", 1) for a in given.arg)
            found = shell.script(Path(given.script).read_text(), args)
            if found is not None:
                print(shell.show(found))
        else:
            return _interactive(shell)
    except (QueryError, SyntaxProblem, OSError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
    return 0


def _interactive(shell: Shell) -> int:
    while True:
        try:
            found = shell.line(input("quillon> "))
            if found is not None:
                print(shell.show(found) if isinstance(found, Relation) else found)
        except EOFError:
            return 0
        except Exception as problem:  # the session goes on after any error of a line
            print(f"error: {problem}", file=sys.stderr)
