import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture()
def sample(spark):
    """A session with the sample relations."""
    from quillon.session import Session
    from quillon.sources import tables

    out = Session(spark)
    for name, relation in tables.sample(spark).items():
        out.bind(name, relation)
    return out


@pytest.fixture()
def rows(sample):
    """Runs statements; gives the last relation's rows as sorted tuples, attributes by name."""

    def run(*statements):
        last = None
        for statement in statements:
            last = sample.run(statement)
        names = last.df.columns if last.ordered else sorted(last.df.columns)
        df = last.df if last.ordered else last.as_set().df
        found = [tuple(r[n] for n in names) for r in df.collect()]
        return found if last.ordered else sorted(found, key=repr)

    return run
