"""Walks over DataFrames against plain Python on graphs with known answers."""

import random
from collections import deque

import pytest

from plumbline.graph import traverse

GRAPHS = {
    "chain": [(i, i + 1) for i in range(12)],
    "diamond": [(0, 1), (0, 2), (1, 3), (2, 3), (2, 3)],
    "self loop": [(0, 0), (0, 1)],
    "cycle": [(0, 1), (1, 2), (2, 0), (2, 3)],
    "apart": [(0, 1), (5, 6)],
    "random": [(a, b) for a, b in ((random.Random(i).randint(0, 60), random.Random(i + 999).randint(0, 60)) for i in range(150)) if a < b],
}


@pytest.fixture(autouse=True, params=[0, 200_000], ids=["joins", "driver"])
def place(request, monkeypatch):
    """Every walk both as rounds of joins and on the driver."""
    monkeypatch.setattr(traverse, "LOCAL_EDGES", request.param)


def frame(spark, edges):
    return spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string")


def depths(edges, start):
    out, todo = {start: 0}, deque([start])
    while todo:
        at = todo.popleft()
        for a, b in edges:
            if a == at and b not in out:
                out[b] = out[at] + 1
                todo.append(b)
    return out


@pytest.mark.parametrize("name", GRAPHS)
def test_reach_and_leaves(spark, name):
    e = GRAPHS[name]
    df, start = frame(spark, e), spark.createDataFrame([("n0",)], "node string")
    want = {f"n{k}": v for k, v in depths(e, 0).items()}
    assert {r.node: r.depth for r in traverse.reach(df, start).collect()} == want
    assert {r.node for r in traverse.leaves(df, start).collect()} == {n for n in want if n not in {f"n{a}" for a, _ in e}}


def test_shortest_path(spark):
    df = frame(spark, [(0, 1), (1, 2), (2, 5), (0, 3), (3, 5), (0, 4), (4, 5)])
    assert traverse.shortest_path(df, "n0", "n5").first().path == ["n0", "n3", "n5"]
    assert traverse.shortest_path(df, "n5", "n0").collect() == []


def test_levels_with_a_cycle(spark):
    got = {r.node: r.level for r in traverse.levels(frame(spark, [(0, 1), (1, 2), (0, 2), (7, 8), (8, 7), (8, 9)])).collect()}
    assert got == {"n0": 0, "n1": 1, "n2": 2, "n7": None, "n8": None, "n9": None}


def test_simplify_stops_at_kept_nodes(spark):
    df = frame(spark, [(0, 1), (1, 2), (2, 3), (1, 4), (4, 5)])
    kept = spark.createDataFrame([("n0",), ("n2",), ("n3",), ("n5",)], "node string")
    assert {tuple(r) for r in traverse.simplify(df, kept).collect()} == {("n0", "n2"), ("n2", "n3"), ("n0", "n5")}


def test_propagation(spark):
    nodes = spark.createDataFrame([("n0", True, "a", ["x"]), ("n1", None, "b", None), ("n2", None, None, ["y"]), ("n3", None, None, None)], "node string, pii boolean, owner string, tags array<string>")
    got = {r.node: (r.pii, r.owner, r.tags) for r in traverse.propagate(nodes, frame(spark, [(0, 2), (1, 2), (0, 3)])).collect()}
    assert got["n2"] == (True, None, ["x", "y"]) and got["n3"] == (True, "a", ["x"]) and got["n1"][0] is False


def test_propagation_merges_rows_of_one_node(spark):
    schema = "node string, pii boolean, owner string, tags array<string>"
    nodes = spark.createDataFrame([("n0", None, "a", ["y"]), ("n0", True, None, ["x", "y"]), ("n1", None, None, None), ("n1", None, "", ["z"]), ("n2", None, "b", None), ("n2", None, "c", None)], schema)
    want = {("n0", True, "a", ("x", "y")), ("n1", True, "", ("x", "y", "z")), ("n2", False, None, ())}
    got = [(r.node, r.pii, r.owner, tuple(r.tags)) for r in traverse.propagate(nodes, frame(spark, [(0, 1)])).collect()]
    assert len(got) == 3 and set(got) == want
    alone = [(r.node, r.pii, r.owner, r.tags) for r in traverse.propagate(nodes.where("node = 'n2'"), frame(spark, [(0, 1)]).limit(0)).collect()]
    assert alone == [("n2", False, None, [])]
