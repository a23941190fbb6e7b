"""Workspaces: a folder with one Parquet table for each relation and a manifest."""

from __future__ import annotations

import json

from quillon.operators.relation import Relation
from quillon.session import Session

MANIFEST = "manifest"


def save(session: Session, path: str) -> None:
    """Writes all named relations, nested ones and declared types included. Aliases and functions
    are not saved."""
    entries = []
    for at, (name, relation) in enumerate(sorted(session.relations.items())):
        relation.as_set().df.write.mode("overwrite").parquet(f"{path}/r{at}")
        entries.append(
            {
                "name": name,
                "table": f"r{at}",
                "declared": relation.declared,
                "keys": [sorted(k) for k in relation.keys],
            }
        )
    manifest = session.spark.createDataFrame([(json.dumps(e),) for e in entries], "entry string")
    manifest.coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")


def load(session: Session, path: str) -> list[str]:
    """Names the relations of a workspace; returns the names."""
    names = []
    for row in session.spark.read.text(f"{path}/{MANIFEST}").collect():
        entry = json.loads(row.value)
        df = session.spark.read.parquet(f"{path}/{entry['table']}")
        keys = tuple(frozenset(k) for k in entry["keys"])
        session.bind(entry["name"], Relation(df, distinct=True, keys=keys, declared=entry["declared"]))
        names.append(entry["name"])
    return names
