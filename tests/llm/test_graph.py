"""Connected components, at once and in rounds, against union by sets."""

import random

import pytest

from quillon.llm.graph import components


@pytest.mark.parametrize("at_once", [1_000_000, 0])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, at_once, shape):
    rng = random.Random(5)
    links = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(99, i) for i in range(30)],
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(3, 3)],
        "none": [],
    }[shape]
    groups = {x: {x} for a, b in links for x in (a, b) if a != b}
    for a, b in links:
        if a != b:
            both = groups[a] | groups[b]
            for x in both:
                groups[x] = both
    found = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long"), at_once).collect()}
    assert found == {x: min(g) for x, g in groups.items()}
