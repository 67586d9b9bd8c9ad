"""Chains, reachability, redundant edges and components against plain searches, and how their rounds and rows grow."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hashgrove.operators import graphs, lineage
from helpers import rows


def frame(spark, pairs):
    return spark.createDataFrame(sorted(pairs, key=repr), "src string, dst string")


def reach(pairs):
    """For each node with an edge out, the nodes at one or more edges from it."""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    found = {}
    for start in after:
        todo, seen = list(after[start]), set()
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo += after.get(node, ())
        found[start] = seen
    return found


def several(seed, graphs_=40, nodes=9, acyclic=False):
    """Many small random graphs in one table."""
    rng, pairs = random.Random(seed), set()
    for g in range(graphs_):
        n = rng.randint(2, nodes)
        for _ in range(rng.randint(1, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            if acyclic:
                a, b = min(a, b), max(a, b)
                if a == b:
                    continue
            pairs.add((f"g{g:02d}n{a}", f"g{g:02d}n{b}"))
    return pairs


def stretched(pairs, seed, most=6):
    """The same graphs with some edges replaced by chains."""
    rng, out = random.Random(seed), set()
    for a, b in sorted(pairs):
        way = [a, *[f"{a}-{b}-{i}" for i in range(rng.choice([0, 0, 1, most]))], b]
        out |= set(zip(way, way[1:]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    pairs = stretched(several(seed), seed)
    behind = reach(pairs)
    expected = {(a, min(b for b in behind[a] if a in behind.get(b, ()))) for a in behind if a in behind[a]}
    assert set(rows(graphs.strong_components(frame(spark, pairs)))) == expected


def test_rings_loops_and_long_cycles(spark):
    ring = {(f"r{i:03d}", f"r{(i + 1) % 300:03d}") for i in range(300)}
    long = {(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)} | {("c200", "c000"), ("x", "c100"), ("c050", "y"), ("c150", "c020")}
    loops = {("s", "s"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("c", "s")}
    found = dict(rows(graphs.strong_components(frame(spark, ring | long | loops))))
    expected = {**{f"r{i:03d}": "r000" for i in range(300)}, **{f"c{i:03d}": "c000" for i in range(201)}, "s": "s", "a": "a", "b": "a", "c": "a"}
    assert found == expected


def test_odd_edges(spark):
    odd = spark.createDataFrame([("a", None), (None, "b"), ("a", "b"), ("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert rows(lineage.reduction(odd)) == [("a", "b"), ("b", "c")]
    assert rows(graphs.strong_components(odd)) == []
    none = odd.limit(0)
    assert graphs.strong_components(none).count() == lineage.reduction(none).count() == graphs.reachable(none, none.select(F.col("src").alias("node"))).count() == 0


def test_a_large_acyclic_table_makes_few_rows(spark, monkeypatch):
    pairs = {(f"t{i}", f"t{j}") for i in range(1, 3000) for j in ((i - 1) // 2, (i - 1) // 3)}
    written = _rows_written(spark, monkeypatch)
    assert graphs.strong_components(frame(spark, pairs)).count() == 0
    assert sum(written) < 12 * len(pairs)


def _rows_written(spark, monkeypatch):
    counts = []

    def counting(write):
        def run(*args):
            out = write(*args)
            counts.append(out.count())
            return out

        return run

    monkeypatch.setattr(graphs, "materialize", counting(graphs.materialize))
    monkeypatch.setattr(graphs.Log, "add", counting(graphs.Log.add))
    return counts


def needed(pairs):
    """Edges of an acyclic graph that no longer way replaces."""
    behind = reach(pairs)
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    return {(a, b) for a, b in pairs if not any(b in behind.get(m, ()) for m in after[a] if m != b)}


@pytest.mark.parametrize("seed", [3, 4])
def test_redundant_edges_of_random_graphs(spark, seed):
    pairs = stretched(several(seed, acyclic=True), seed)
    assert set(rows(lineage.reduction(frame(spark, pairs)))) == needed(pairs)


@pytest.mark.parametrize("pairs", [{("a", "b"), ("b", "a")}, {("a", "a")}, {("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d")}])
def test_a_reduction_refuses_cycles(spark, pairs):
    with pytest.raises(ValueError, match="cycle"):
        lineage.reduction(frame(spark, pairs))


def test_reduction_of_a_chain_of_2000(spark, monkeypatch):
    name = "t{:04d}".format
    pairs = {(name(i), name(i + 1)) for i in range(1999)} | {(name(0), name(1999)), (name(5), name(900)), (name(5), name(1500)), (name(880), name(910))}
    written = _rows_written(spark, monkeypatch)
    found = set(rows(lineage.reduction(frame(spark, pairs))))
    assert found == {(name(i), name(i + 1)) for i in range(1999)}
    # a closure would have 1,999,000 rows
    assert max(written) <= 2 * len(pairs) and len(written) < 60


def test_a_hub_costs_its_edges(spark, monkeypatch):
    n = 400
    pairs = {("root", f"a{i}") for i in range(n)} | {(f"a{i}", "end") for i in range(n)} | {("root", "end")} | {(f"a{i}", f"a{i + 1}") for i in range(0, n - 1, 2)}
    written = _rows_written(spark, monkeypatch)
    assert set(rows(lineage.reduction(frame(spark, pairs)))) == needed(pairs)
    # the hub's siblings would make 160,000 pairs
    assert max(written) <= 3 * len(pairs)


def test_reachable_nodes_of_random_graphs(spark):
    pairs = stretched(several(7), 7) | {(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)}
    nodes = sorted({n for p in pairs for n in p})
    behind = reach(pairs)
    for k, part in enumerate((nodes[:1], random.Random(1).sample(nodes, 25), ["r3", "elsewhere", None])):
        seeds = spark.createDataFrame([(s,) for s in [*part, *part]], "node string")
        expected = {x for s in part if s in nodes for x in {s} | behind.get(s, set())}
        assert {r[0] for r in rows(graphs.reachable(frame(spark, pairs), seeds))} == expected, k


def test_1000_declarations_in_a_row_take_few_rounds(spark, monkeypatch):
    sets = [(i, side, f"t{i + (side == 'to')}") for i in range(1000) for side in ("from", "to")]
    sets += [(500, "from", "other"), (2000, "from", "t990"), (2000, "to", "far")]
    declared = spark.createDataFrame(sets, "decl_id int, side string, task string")
    rounds = []
    for owner, name in ((graphs, "materialize"), (graphs.Log, "add")):
        monkeypatch.setattr(owner, name, lambda *a, f=getattr(owner, name): (rounds.append(a[-1]), f(*a))[1])
    found = set(rows(lineage.spread_label(declared, spark.createDataFrame([("t3",)], "task string"))))
    assert found == {("t3", "t3"), ("t501", "other"), ("far", "t990")} | {(f"t{i + 1}", f"t{i}") for i in range(3, 1000)}
    # rounds of doubling and of the search after it; the rest are the tables before and between
    assert sum(r == "chains" for r in rounds if isinstance(r, str)) + sum(not isinstance(r, str) for r in rounds) <= 25


def test_a_round_reads_only_edges_of_its_sources(spark, monkeypatch):
    edges = [(f"{a}{i}", f"{b}{i + (a == 'd')}") for i in range(6) for a, b in ("td", "dt")]
    seen, behind = [], graphs._behind
    monkeypatch.setattr(graphs, "_behind", lambda arcs, *rest: seen.append({r["src"][0] for r in arcs.collect()}) or behind(arcs, *rest))
    seeds = spark.createDataFrame([("t3",), ("t9",)], "node string")
    table = spark.createDataFrame(edges + edges, "src string, dst string")
    assert {r["node"] for r in graphs.reachable(table, seeds).collect()} == {"t3", "t4", "t5", "t6", "d3", "d4", "d5"}
    assert seen[0] == {"t"} and seen[1] == {"d"}
    assert "t9" in {r["node"] for r in graphs.reachable(table, seeds, within=False).collect()}


def test_small_pieces_are_solved_without_rounds(spark, monkeypatch):
    pairs = several(11, graphs_=60, acyclic=True)
    turned = pairs | {(b, a) for a, b in sorted(pairs)[::7]}
    for name in ("peel", "chains", "contracted"):
        monkeypatch.setattr(graphs, name, lambda *a, n=name, **k: pytest.fail(f"{n} goes over all edges in rounds"))
    written = _rows_written(spark, monkeypatch)
    assert set(rows(lineage.reduction(frame(spark, pairs)))) == needed(pairs)
    behind = reach(turned)
    expected = {(a, min(b for b in behind[a] if a in behind.get(b, ()))) for a in behind if a in behind[a]}
    assert set(rows(lineage.cycles(frame(spark, turned)))) == expected
    assert len(written) <= 2 * (2 * (graphs.LEVELS + 1) + 1) and max(written) <= len(turned)


def test_small_and_large_pieces_in_one_table(spark):
    # a hub, a long chain, a piece of 32 nodes and one of 33 beside small ones; repeats
    pairs = several(12, acyclic=True) | {("hub", f"h{i:02d}") for i in range(50)} | {("h00", "h01"), ("in", "hub"), ("in", "h07")}
    pairs |= {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(60)} | {("c03", "c50")}
    for n in (graphs.SMALL, graphs.SMALL + 1):
        pairs |= {(f"s{n}-00", f"s{n}-{i:02d}") for i in range(1, n)} | {(f"s{n}-{i:02d}", f"s{n}-{n - 1:02d}") for i in range(1, n - 1)}
    table = frame(spark, pairs)
    assert set(rows(lineage.reduction(table.union(table)))) == needed(pairs)
    back = pairs | {("h09", "in"), ("c60", "c10"), ("s32-31", "s32-00"), ("s33-32", "s33-05")}
    behind = reach(back)
    expected = {(a, min(b for b in behind[a] if a in behind.get(b, ()))) for a in behind if a in behind[a]}
    assert set(rows(lineage.cycles(frame(spark, back)))) == expected
