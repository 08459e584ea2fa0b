"""Components: by rounds, by rounds that end in one task, and by that task alone."""

import random

import pytest

from convmem.llm import components as narrow
from convmem.operators import graph


def _least(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


@pytest.mark.parametrize("few", [0, 40, 10_000])
@pytest.mark.parametrize("module", [graph, narrow])
def test_components(spark, module, few):
    r = random.Random(few)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = module.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), few).collect()
    assert {n: c for n, c in got} == _least(edges) and len(got) == len(_least(edges))


@pytest.mark.parametrize("few", [0, 10_000])
def test_names_as_nodes(spark, few):
    got = graph.components(spark.createDataFrame([("x", "y"), ("y", "z"), ("p", "q")], "a string, b string"), few).collect()
    assert {n: c for n, c in got} == {"x": "x", "y": "x", "z": "x", "p": "p", "q": "p"}


@pytest.mark.parametrize("module", [graph, narrow])
def test_few_edges_take_no_rounds(spark, module):
    """A chain of 300 takes some ten rounds of several jobs each; in one task it is done at once."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few", "few")
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert module.components(chain).where("component = 0").count() == 301
    jobs = len(tracker.getJobIdsForGroup("few"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 30


@pytest.mark.parametrize("module", [graph, narrow])
def test_nothing(spark, module):
    assert module.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
