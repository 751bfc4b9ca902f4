"""Hierarchies against brute force, in one task and by the distributed way."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import hierarchy as H

SCHEMA = "manifest_id long, id string, dependencies array<string>, node string, scope int"


def brute(rows):
    up = {}
    for m, i, *_ in rows:
        if m is not None and i is not None:
            up.setdefault((m, i), set())
    for m, i, deps, *_ in rows:
        for d in deps or []:
            if d and (m, i) in up and (m, d) in up:
                up[m, i].add((m, d))
    reach = {}
    for v in up:
        seen, todo = set(), list(up[v])
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += up[w]
        reach[v] = seen
    return up, reach


def graph(seed, n, scopes, extra):
    rnd = random.Random(seed)
    rows = []
    for m in range(scopes):
        for i in range(n):
            deps = [f"n{rnd.randrange(max(1, i))}"] if i and rnd.random() < 0.8 else []
            if rnd.random() < extra:
                deps += [f"n{rnd.randrange(n)}", None, "", "unknown"]
            rows.append((m, f"n{i}", rnd.choice([deps, deps, None]) if not deps else deps, "clash", 1))
    return rows + rows[:5] + [(None, "n1", ["n2"], "x", 0), (0, None, ["n2"], "x", 0)]


@pytest.mark.parametrize(("seed", "task_links"), [(1, H.TASK_LINKS), (2, H.TASK_LINKS), (1, 7)])
def test_against_brute_force(spark, seed, task_links):
    rows = graph(seed, 22, 2, 0.12)
    df = spark.createDataFrame(rows, SCHEMA)
    up, reach = brute(rows)
    circles = {v for v in up if v in reach[v]}
    got = {tuple(r) for r in H.hierarchy(df, "circles", task_links=task_links).collect()}
    assert got == circles
    if task_links > 7:
        pairs = {tuple(r) for r in H.hierarchy(df, "descendants", task_links=task_links).collect()}
        assert pairs == {(w[0], w[1], v[1]) for v in up for w in reach[v]}
    nodes = {(r["scope"], r["node"]): r for r in H.hierarchy(df, "nodes", task_links=task_links).collect()}
    assert set(nodes) == set(up)
    same = lambda v: {w for w in reach[v] if v in reach[w]} | {v}
    for v, r in nodes.items():
        assert r["in_circle"] == (v in circles)
        assert r["n_descendants"] == sum(1 for w in up if v in reach[w])
        tops = {min(same(w)) for w in reach[v] | {v} if all(x in same(w) for x in reach[w])}
        assert r["roots"] == sorted(t[1] for t in tops)
    paths = H.hierarchy(df, "paths", task_links=task_links).collect()
    count = {}
    for r in paths:
        count[r["scope"], r["node"]] = count.get((r["scope"], r["node"]), 0) + 1
        assert len(r["path"]) == r["depth"] + 1 and r["path"][-1] == r["node"]
    assert count == {v: int(r["n_paths"]) for v, r in nodes.items()}
    longest = {}
    for r in paths:
        longest[r["scope"], r["node"]] = max(longest.get((r["scope"], r["node"]), 0), r["depth"])
    assert longest == {v: r["depth"] for v, r in nodes.items()}


@pytest.mark.parametrize("task_links", [H.TASK_LINKS, 5])
def test_components_and_offsets(spark, task_links):
    rows = graph(5, 40, 1, 0.05)
    nodes, links = H.node_links(spark.createDataFrame(rows, SCHEMA))
    got = {r["node"]: r for r in H.components(links, task_links).collect()}
    up, _ = brute(rows)
    group = {v[1]: v[1] for v in up}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    edges = [(v[1], w[1]) for v in up for w in up[v]]
    for a, b in edges:
        group[find(a)] = find(b)
    linked = {x for e in edges for x in e}
    assert set(got) == linked
    for a in linked:
        for b in linked:
            assert (got[a]["root"] == got[b]["root"]) == (find(a) == find(b))
    for a, b in edges:  # without conflict every link holds
        if not got[a]["conflict"]:
            assert got[a]["offset"] == got[b]["offset"] + 1


def test_circles_of_single_parents_and_through_joins(spark):
    ring = [(1, f"r{i}", [f"r{(i + 1) % 9}"], "", 0) for i in range(9)] + [(1, f"h{i}", [f"h{i - 1}" if i else "r3"], "", 0) for i in range(6)]
    loop = [(1, f"c{i}", [f"c{i - 1}"] if i else ["j"], "", 0) for i in range(12)] + [(1, "j", ["c11", "c4", "h5"], "", 0), (1, "x", ["c7"], "", 0), (1, "self", ["self", "x"], "", 0)]
    df = spark.createDataFrame(ring + loop, SCHEMA)
    up, reach = brute(ring + loop)
    for task_links in (3, H.TASK_LINKS):
        nodes = H.hierarchy(df, "nodes", task_links=task_links).collect()
        assert {(1, r["node"]) for r in nodes if r["in_circle"]} == {v for v in up if v in reach[v]}
        got = {r["node"]: r["n_descendants"] for r in nodes}
        assert got == {v[1]: sum(1 for w in up if v in reach[w]) for v in up}


def test_long_chain_takes_few_rounds(spark):
    n = 1_500
    rows = spark.range(n).select(F.lit(1).cast("long").alias("manifest_id"), F.format_string("n%06d", "id").alias("id"), F.when(F.col("id") > 0, F.array(F.format_string("n%06d", F.col("id") - 1))).alias("dependencies"))
    for task_links in (600, H.TASK_LINKS):
        got = H.hierarchy(rows, "nodes", task_links=task_links).agg(F.max("depth"), F.sum("n_descendants"), F.max("n_paths"), F.count_if("in_circle")).first()
        assert tuple(got) == (n - 1, n * (n - 1) // 2, 1.0, 0)


def test_descendants_above_the_bound(spark):
    rows = graph(3, 12, 1, 0.1)
    up, reach = brute(rows)
    got = {tuple(r) for r in H.hierarchy(spark.createDataFrame(rows, SCHEMA), "descendants", task_links=5).collect()}
    assert got == {(w[0], w[1], v[1]) for v in up for w in reach[v]}


def test_ladder_of_diamonds_stays_within_memory():
    depth, child, parent = 2_000, [], []
    for i in range(depth):
        child += [f"{i}a", f"{i}b", f"{i + 1}t", f"{i + 1}t"]
        parent += [f"{i}t", f"{i}t", f"{i}a", f"{i}b"]
    import tracemalloc

    tracemalloc.start()
    rows = {r[0]: r for r in H.Walk(child, parent).nodes()}
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
    assert rows[f"{depth}t"][3] == 2 * depth and rows[f"{depth}t"][5] == float("inf") and rows["3t"][5] == 8.0
    assert rows["0t"][6] == 3 * depth and rows[f"{depth}t"][6] == 0


def test_small_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for kind in H.SHAPES:
        assert H.hierarchy(empty, kind).count() == 0
    own = spark.createDataFrame([(1, "a", ["a"], "", 0), (1, "b", ["a", "a"], "", 0)], SCHEMA)
    assert [tuple(r) for r in H.hierarchy(own, "circles").collect()] == [(1, "a")]
    r = {x["node"]: x for x in H.hierarchy(own, "nodes").collect()}
    assert r["b"]["roots"] == ["a"] and r["b"]["depth"] == 1 and r["a"]["circle"] == "a"
    long = spark.createDataFrame([(1, f"n{i:04}", [f"n{i - 1:04}"] if i else None, "", 0) for i in range(1500)], SCHEMA)
    assert H.hierarchy(long, "nodes").agg(F.max("depth"), F.sum("n_descendants")).first()[0] == 1499
