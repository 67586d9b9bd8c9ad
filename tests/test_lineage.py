from __future__ import annotations

import random

import pytest

from hashgrove.operators import lineage
from helpers import rows


def edge_frame(spark, pairs, mode="not_ok"):
    return spark.createDataFrame([(*p, mode) if len(p) == 2 else p for p in pairs], "src string, dst string, mode string")


def reachable(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    found = set()
    for start in after:
        todo = list(after[start])
        seen = set()
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += after.get(node, ())
        found |= {(start, node) for node in seen}
    return found


def random_dag(seed, nodes=14, n=30):
    rng = random.Random(seed)
    pairs = set()
    while len(pairs) < n:
        a, b = sorted(rng.sample(range(nodes), 2))
        pairs.add((f"t{a:02d}", f"t{b:02d}"))
    return pairs


def test_product_of_declared_sets(spark):
    declared = [(1, "from", "a", "ok"), (1, "from", "b", "ok"), (1, "to", "c", "ok"), (1, "to", "d", "ok"),
                (2, "from", "a", "not_ok"), (2, "to", "c", "not_ok"), (3, "from", "a", "ok"), (3, "to", "c", "ok")]
    df = spark.createDataFrame(declared, "decl_id int, side string, task string, mode string")
    assert rows(lineage.build_edges(df)) == [
        ("a", "c", "not_ok"), ("a", "c", "ok"), ("a", "d", "ok"), ("b", "c", "ok"), ("b", "d", "ok")
    ]


def test_root_and_final_edges(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("a",)], "task string")
    assert rows(lineage.root_edges(tasks, "root")) == [("root", "a", "not_ok"), ("root", "b", "not_ok")]
    assert rows(lineage.final_edges(tasks, ["x", "y"]), "src", "dst", "mode") == [
        ("a", "x", "ok"), ("a", "y", "ok"), ("b", "x", "ok"), ("b", "y", "ok")
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_and_reduction_laws(spark, seed):
    pairs = random_dag(seed)
    edges = edge_frame(spark, sorted(pairs))
    assert set(rows(lineage.closure(edges))) == reachable(pairs)
    reduced = set(rows(lineage.reduction(edges)))
    assert reduced <= pairs and reachable(reduced) == reachable(pairs)
    for edge in reduced:  # every edge kept is needed
        assert reachable(reduced - {edge}) != reachable(pairs)


def test_long_path(spark):
    pairs = {(f"{i:03d}", f"{i + 1:03d}") for i in range(40)}
    assert lineage.closure(edge_frame(spark, sorted(pairs))).count() == 41 * 40 // 2


def test_closure_without_edges(spark):
    assert lineage.closure(edge_frame(spark, [])).count() == 0


def test_round_limit(spark):
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(10)]
    with pytest.raises(RuntimeError, match="longer"):
        lineage.closure(edge_frame(spark, pairs), max_rounds=2)


def test_hub_between_many(spark):
    pairs = [(f"a{i}", "hub") for i in range(50)] + [("hub", f"b{i}") for i in range(50)]
    assert set(rows(lineage.closure(edge_frame(spark, pairs)))) == reachable(pairs)
    assert set(rows(lineage.reduction(edge_frame(spark, pairs)))) == set(pairs)


def test_cycles_are_found_and_refused(spark):
    edges = edge_frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert rows(lineage.cycles(edges)) == [("a", "a"), ("b", "a"), ("c", "a")]
    with pytest.raises(ValueError, match="cycle"):
        lineage.reduction(edges)


def test_rules_and_conflicts(spark):
    edges = edge_frame(spark, [("a", "c", "ok"), ("b", "c", "not_ok"), ("a", "d", "ok"), ("a", "e", "not_ok")])
    assert rows(lineage.trigger_rules(edges)) == [("c", "all_done"), ("d", "all_done"), ("e", "all_success")]
    assert rows(lineage.trigger_conflicts(edges)) == [("c", 1, 1)]


def _declared(spark, *sets):
    sides = [(i, side, t) for i, (before, after) in enumerate(sets) for side, ts in (("from", before), ("to", after)) for t in ts]
    return spark.createDataFrame(sides, "decl_id int, side string, task string")


@pytest.mark.parametrize(
    ("sets", "seeds", "expected"),
    [
        ([("b", "c"), ("a", "b")], "a", [("a", "a"), ("b", "a"), ("c", "b")]),
        ([("ax", "cd")], "a", [("a", "a"), ("c", "a"), ("c", "x"), ("d", "a"), ("d", "x")]),
        ([("ab", "c"), ("c", "ad")], "b", [("a", "c"), ("b", "b"), ("c", "a"), ("c", "b"), ("d", "c")]),
        ([("x", "y")], "a", [("a", "a")]),
        ([], "", []),
    ],
)
def test_label_follows_declarations(spark, sets, seeds, expected):
    seeds = spark.createDataFrame([(s,) for s in seeds], "task string")
    assert rows(lineage.spread_label(_declared(spark, *sets), seeds)) == expected


def test_ready_tasks(spark):
    edges = edge_frame(spark, [("a", "c"), ("b", "c"), ("a", "d")])
    done = spark.createDataFrame([("a",)], "task string")
    assert rows(lineage.ready_tasks(edges, done)) == [("c", False, 1), ("d", True, 0)]


def test_set_operations(spark):
    a, b = edge_frame(spark, [("a", "b"), ("a", "b"), ("c", "d")]), edge_frame(spark, [("c", "d"), ("e", "f")])
    assert len(rows(lineage.bag_union(a, b))) == 5
    assert rows(lineage.edge_union(a, b)) == [("a", "b"), ("c", "d"), ("e", "f")]
    assert rows(lineage.edge_intersection(a, b)) == [("c", "d")]
    assert rows(lineage.edge_difference(a, b)) == [("a", "b")]
