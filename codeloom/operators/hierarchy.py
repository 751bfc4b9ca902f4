"""Parent-child links to full hierarchies.

Links join a node to the nodes it hangs under, within a scope. Weighted disjoint-set forests label every node with
the root of its component and its offset from that root: first over the links of one partition, then over links between
partition roots, merged until one forest is left. Links that contradict the offsets mark the components that may hold
circles; the others are proved free of them. Paths, depths, roots and descendants then come from walking an index of
each component's parents.

Defined cases. A row without scope or node names no node. Null, empty and unknown parents lead nowhere. Repeated rows
and repeated links count once. A node that is its own parent is a circle of one. Empty input gives an empty result.
Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import cut, cut_loop, is_small, lookup, partitions

#: Links that one task may hold. Scopes and components above it go through the distributed way.
TASK_LINKS = 500_000
#: Rows of an output batch.
BATCH = 20_000
#: Members whose places above are counted at a time; a task holds so many bits per place.
BITS = 2_048
#: Fronts of a search that are read apart before they are written together.
FRONTS = 12


def node_links(rows: DataFrame, scope: str = "manifest_id", node: str = "id", parents: str = "dependencies") -> tuple[DataFrame, DataFrame]:
    """(nodes(scope, node), links(scope, node, parent)): distinct, links only to nodes of the scope that exist."""
    base = rows.select(F.col(scope).alias("scope"), F.col(node).alias("node"), F.col(parents).alias("parents")).where("scope is not null and node is not null")
    nodes = base.select("scope", "node").distinct()
    links = base.select("scope", "node", F.explode("parents").alias("parent")).where("parent is not null and parent <> ''").distinct()
    known = nodes.select("scope", F.col("node").alias("parent"))
    return nodes, links.join(known, ["scope", "parent"], "left_semi").select("scope", "node", "parent")


class Forest:
    """Weighted disjoint sets: potential(a) = potential(b) + w for every link, or the set is marked as in conflict."""

    def __init__(self) -> None:
        self.index: dict = {}
        self.up: list[int] = []
        self.off: list[int] = []
        self.count: list[int] = []
        self.conflict: list[bool] = []

    def vertex(self, key: object) -> int:
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.up)
            self.up.append(at)
            self.off.append(0)
            self.count.append(1)
            self.conflict.append(False)
        return at

    def find(self, at: int) -> tuple[int, int]:
        path = []
        while self.up[at] != at:
            path.append(at)
            at = self.up[at]
        total = 0
        for x in reversed(path):
            total += self.off[x]
            self.up[x], self.off[x] = at, total
        return at, total

    def link(self, a: object, b: object, w: int) -> None:
        x, y = self.vertex(a), self.vertex(b)
        (rx, ox), (ry, oy) = self.find(x), self.find(y)
        if rx == ry:
            self.conflict[rx] |= ox != oy + w
            return
        gap = oy + w - ox  # potential(rx) - potential(ry)
        if self.count[rx] > self.count[ry]:
            rx, ry, gap = ry, rx, -gap
        self.up[rx], self.off[rx] = ry, gap
        self.count[ry] += self.count[rx]
        self.conflict[ry] |= self.conflict[rx]

    def rows(self) -> Iterator[tuple[object, object, int, bool]]:
        """(vertex, least vertex of its set, offset from that, conflict) for each vertex."""
        found = {key: self.find(at) for key, at in self.index.items()}
        least: dict[int, object] = {}
        for key, (root, _) in found.items():
            if root not in least or key < least[root]:
                least[root] = key
        for key, (root, off) in found.items():
            yield key, least[root], off - found[least[root]][1], self.conflict[root]


def _forests(scope_type: str):
    schema = f"scope {scope_type}, salt int, node string, root string, offset long, conflict boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for pdf in batches:
            for scope, salt, a, b, w in zip(*(pdf[c].tolist() for c in ("scope", "salt", "node", "parent", "w"))):
                forest.link((scope, salt, a), (scope, salt, b), w)
        out = []
        for (scope, salt, node), (_, _, root), off, conflict in forest.rows():
            out.append((scope, salt, node, root, off, conflict))
            if len(out) == BATCH:
                yield pd.DataFrame(out, columns=["scope", "salt", "node", "root", "offset", "conflict"])
                out = []
        yield pd.DataFrame(out, columns=["scope", "salt", "node", "root", "offset", "conflict"])

    return run, schema


def _local(links: DataFrame, tasks: int) -> DataFrame:
    """One forest per partition; all links of a (scope, salt) lie in one partition."""
    run, schema = _forests(dict(links.dtypes)["scope"])
    return links.select("scope", "salt", "node", "parent", "w").repartition(tasks, "scope", "salt").mapInPandas(run, schema)


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(scope, node, root, offset, conflict): the weakly connected component of every linked node.

    offset is the node's distance below the root as its links tell it; conflict says that the component's links
    contradict each other, which every circle does. A scope of more than task_links links is salted into several
    forests, whose roots are joined through shared nodes in halving rounds until one task can hold what is left.
    """
    spark = links.sparkSession
    sizes = links.groupBy("scope").count()
    hot = cut(sizes.where(F.col("count") > task_links).select("scope", F.ceil(F.col("count") / task_links).cast("int").alias("salts")))
    total = links.count()
    tasks = max(1, min(partitions(spark), total // 5_000 + 1), -(-total // task_links))
    weighted = links.withColumn("w", F.lit(1).cast("long"))
    if hot.isEmpty():
        return _local(weighted.withColumn("salt", F.lit(0)), tasks).drop("salt")
    few = is_small(hot)
    marked = weighted.join(F.broadcast(hot) if few else hot, "scope", "left")
    salted = marked.withColumn("salt", F.coalesce(F.pmod(F.hash("node"), F.col("salts")), F.lit(-1)).cast("int")).drop("salts")
    labels = cut(_local(salted, tasks))
    cold, wide = labels.where("salt = -1").drop("salt"), labels.where("salt >= 0")
    wide = wide.withColumn("v", F.concat_ws("|", F.lpad(F.col("salt").cast("string"), 9, "0"), "root"))
    # P(node) = P(v) + offset in every salt that holds the node; tie each to the least of them
    same = Window.partitionBy("scope", "node")
    bridges = (
        wide.withColumn("first", F.min(F.struct("v", "offset")).over(same))
        .where("v <> first.v")
        .select("scope", F.col("v").alias("node"), F.col("first.v").alias("parent"), (F.col("first.offset") - F.col("offset")).alias("w"))
        .distinct()
    )
    bridges = cut(bridges)
    start = cut(wide.groupBy("scope", "v").agg(F.max("conflict").alias("conflict")).select("scope", "v", F.col("v").alias("to"), F.lit(0).cast("long").alias("shift"), "conflict"))
    moved = start
    while not bridges.groupBy("scope").count().where(F.col("count") > task_links).isEmpty():
        moved, bridges = _halve(moved, bridges)
    last = _local(bridges.withColumn("salt", F.lit(0)), tasks).select("scope", F.col("node").alias("to"), F.col("root").alias("top"), F.col("offset").alias("lift"), F.col("conflict").alias("clash"))
    whole = moved.join(last, ["scope", "to"], "left").select(
        "scope", "v", F.coalesce("top", "to").alias("top"), (F.col("shift") + F.coalesce("lift", F.lit(0))).alias("shift"), (F.col("conflict") | F.coalesce("clash", F.lit(False))).alias("clash")
    )
    bad = whole.groupBy("scope", "top").agg(F.max("clash").alias("conflict"))
    final = whole.drop("clash").join(bad, ["scope", "top"])
    per_node = wide.groupBy("scope", "node").agg(F.min(F.struct("v", "offset")).alias("m")).select("scope", "node", "m.v", "m.offset")
    named = per_node.join(final, ["scope", "v"]).select("scope", "node", F.substring_index("top", "|", -1).alias("top0"), F.expr("substring(top, 11)").alias("root"), (F.col("offset") + F.col("shift")).alias("offset"), "conflict").drop("top0")
    return cold.unionByName(named)


def _halve(moved: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of hooking each root to its least neighbour and jumping pointers; at least halves the linked roots."""
    both = bridges.unionByName(bridges.select("scope", F.col("parent").alias("node"), F.col("node").alias("parent"), (-F.col("w")).alias("w")))
    hooks = both.groupBy("scope", "node").agg(F.min(F.struct("parent", "w")).alias("m"))
    point = hooks.select("scope", "node", F.when(F.col("m.parent") < F.col("node"), F.col("m.parent")).otherwise(F.col("node")).alias("up"), F.when(F.col("m.parent") < F.col("node"), F.col("m.w")).otherwise(0).cast("long").alias("lift"))
    point = cut(point)
    while True:
        far = point.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("lift").alias("lift2"))
        nxt = cut(point.join(far, ["scope", "up"]).select("scope", "node", F.col("up2").alias("up"), (F.col("lift") + F.col("lift2")).alias("lift"), (F.col("up") != F.col("up2")).alias("moved")))
        point = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    a = point.select("scope", "node", F.col("up").alias("na"), F.col("lift").alias("la"))
    b = point.select("scope", F.col("node").alias("parent"), F.col("up").alias("nb"), F.col("lift").alias("lb"))
    # P(node) = P(na) + la, P(parent) = P(nb) + lb, P(node) = P(parent) + w
    again = cut(bridges.join(a, ["scope", "node"]).join(b, ["scope", "parent"]).select("scope", F.col("na").alias("node"), F.col("nb").alias("parent"), (F.col("lb") + F.col("w") - F.col("la")).alias("w")).distinct())
    clash = again.where("node = parent and w <> 0").select("scope", F.col("node").alias("to2"), F.lit(True).alias("clash")).distinct()
    step = point.select("scope", F.col("node").alias("to"), F.col("up").alias("to2"), F.col("lift").alias("lift2"))
    moved = moved.join(step, ["scope", "to"], "left").withColumn("to2", F.coalesce("to2", "to")).join(clash, ["scope", "to2"], "left")
    moved = cut(moved.select("scope", "v", F.col("to2").alias("to"), (F.col("shift") + F.coalesce("lift2", F.lit(0))).alias("shift"), (F.col("conflict") | F.coalesce("clash", F.lit(False))).alias("conflict")))
    return moved, again.where("node <> parent")


# ------------------------------------------------------------------ one component in one task


def _index(n: int, child: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pointers and parents, so that parents of i are flat[start[i]:start[i + 1]]."""
    order = np.lexsort((parent, child))
    start = np.zeros(n + 1, np.int64)
    np.add.at(start, child + 1, 1)
    return np.cumsum(start), parent[order]


def _strong(n: int, start: list[int], flat: list[int]) -> list[int]:
    """Strongly connected set of each vertex, numbered so that parents have smaller numbers than their children."""
    number, low, group = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    tick = groups = 0
    for first in range(n):
        if number[first] >= 0:
            continue
        number[first] = low[first] = tick
        tick += 1
        stack.append(first)
        work = [(first, start[first])]
        while work:
            v, at = work[-1]
            if at < start[v + 1]:
                work[-1] = (v, at + 1)
                w = flat[at]
                if number[w] < 0:
                    number[w] = low[w] = tick
                    tick += 1
                    stack.append(w)
                    work.append((w, start[w]))
                elif group[w] < 0:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    while True:
                        w = stack.pop()
                        group[w] = groups
                        if w == v:
                            break
                    groups += 1
    return group


class Walk:
    """The hierarchy of one component, circles drawn together."""

    def __init__(self, child: list[str], parent: list[str | None]) -> None:
        names = sorted({*child, *(p for p in parent if p is not None)})
        at = {x: i for i, x in enumerate(names)}
        pairs = [(at[c], at[p]) for c, p in zip(child, parent) if p is not None]
        c, p = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [])))
        start, flat = _index(len(names), c, p)
        self.names = names
        self.group = _strong(len(names), start.tolist(), flat.tolist())
        n = max(self.group, default=-1) + 1
        self.members: list[list[int]] = [[] for _ in range(n)]
        for i, g in enumerate(self.group):
            self.members[g].append(i)
        ups: list[set[int]] = [set() for _ in range(n)]
        self.circle = [len(m) > 1 for m in self.members]
        for x, y in pairs:
            if self.group[x] != self.group[y]:
                ups[self.group[x]].add(self.group[y])
            elif x == y:
                self.circle[self.group[x]] = True
        self.label = [names[m[0]] for m in self.members]
        self.up = [sorted(u, key=lambda g: self.label[g]) for u in ups]

    def depth(self) -> list[int]:
        out: list[int] = []
        for u in self.up:  # parents come first
            out.append(max((out[x] + 1 for x in u), default=0))
        return out

    def sets(self) -> Iterator[tuple]:
        for i, g in enumerate(self.group):
            if len(self.members[g]) > 1:
                yield self.names[i], self.label[g]

    def circles(self) -> Iterator[tuple]:
        for i, g in enumerate(self.group):
            if self.circle[g]:
                yield (self.names[i],)

    def counts(self) -> list[int]:
        """Members of all places below each place: sums where no place has several parents, else bits of BITS members at a time."""
        size = [len(m) for m in self.members]
        out = [0] * len(size)
        if all(len(u) < 2 for u in self.up):
            for g in range(len(size) - 1, -1, -1):  # children come after their parents
                for u in self.up[g]:
                    out[u] += out[g] + size[g]
            return out
        first = np.concatenate([[0], np.cumsum(size)]).tolist()  # members lie in the order of their places
        for lo in range(0, first[-1], BITS):
            high = min(lo + BITS, first[-1])
            top = bisect_left(first, high)  # only places before this one are above members of the block
            mask = [0] * top
            for g in range(top - 1, -1, -1):
                own = mask[g]
                out[g] += own.bit_count()
                a, b = max(first[g], lo), min(first[g + 1], high)
                if a < b:
                    own |= ((1 << (b - a)) - 1) << (a - lo)
                if own:
                    for u in self.up[g]:
                        mask[u] |= own
                mask[g] = 0
        return out

    def nodes(self) -> Iterator[tuple]:
        depth, count = self.depth(), self.counts()
        roots: list[frozenset[str]] = []
        paths: list[float] = []  # grows without bound on diamonds; infinite beyond what a double holds
        for g, u in enumerate(self.up):
            roots.append(roots[u[0]] if len(u) == 1 else frozenset().union(*(roots[x] for x in u)) if u else frozenset([self.label[g]]))
            paths.append(sum(paths[x] for x in u) if u else 1.0)
        for i, g in enumerate(self.group):
            circle = self.circle[g]
            yield self.names[i], circle, self.label[g] if circle else None, depth[g], sorted(roots[g]), paths[g], count[g] + (len(self.members[g]) if circle else 0)

    def descendants(self) -> Iterator[tuple]:
        down: list[list[int]] = [[] for _ in self.up]
        for g, u in enumerate(self.up):
            for x in u:
                down[x].append(g)
        seen = [-1] * len(down)
        for g, members in enumerate(self.members):
            todo = list(down[g])
            lower = list(members) if self.circle[g] else []
            while todo:
                x = todo.pop()
                if seen[x] != g:
                    seen[x] = g
                    lower += self.members[x]
                    todo += down[x]
            for i in members:
                for x in lower:
                    yield self.names[i], self.names[x]

    def paths(self) -> Iterator[tuple]:
        for i, g in enumerate(self.group):
            trail = [(g, iter(self.up[g]))]
            if not self.up[g]:
                yield self.names[i], self.label[g], [self.names[i]], 0, self.circle[g]
            while trail:
                nxt = next(trail[-1][1], None)
                if nxt is None:
                    trail.pop()
                    continue
                if not self.up[nxt]:
                    steps = [self.names[i]] + [self.label[x] for x, _ in trail[1:]] + [self.label[nxt]]
                    through = any(self.circle[x] for x, _ in trail) or self.circle[nxt]
                    yield self.names[i], self.label[nxt], steps[::-1], len(steps) - 1, through
                else:
                    trail.append((nxt, iter(self.up[nxt])))


#: What a walk can give: method of Walk and the columns after the scope.
SHAPES = {
    "circles": "node string",
    "sets": "node string, label string",
    "nodes": "node string, in_circle boolean, circle string, depth int, roots array<string>, n_paths double, n_descendants long",
    "descendants": "node string, descendant string",
    "paths": "node string, root string, path array<string>, depth int, through_circle boolean",
}


def _walk(grouped: DataFrame, kind: str) -> DataFrame:
    """grouped: (scope, root, node, parent or null). Components are read one after the other from sorted partitions."""
    schema = f"scope {dict(grouped.dtypes)['scope']}, {SHAPES[kind]}"
    columns = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, child, parent = None, [], []

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal out
            if child:
                for row in getattr(Walk(child, parent), kind)():
                    out.append((key[0], *row))
                    if len(out) >= BATCH:
                        yield pd.DataFrame(out, columns=columns)
                        out = []

        for pdf in batches:
            for scope, root, c, p in zip(*(pdf[x].tolist() for x in ("scope", "root", "node", "parent"))):
                if (scope, root) != key:
                    yield from flush()
                    key, child, parent = (scope, root), [], []
                child.append(c)
                parent.append(p)
        yield from flush()
        yield pd.DataFrame(out, columns=columns)

    return grouped.repartition(partitions(grouped.sparkSession), "scope", "root").sortWithinPartitions("scope", "root").mapInPandas(run, schema)


# ------------------------------------------------------------------ components too large for one task


def _reach(start: DataFrame, step: DataFrame) -> DataFrame:
    """All (scope, node, top) that start reaches over step(scope, node, parent), by joining the frontier until it is empty."""
    fronts = [cut_loop(start.select("scope", "node", "top").distinct())]
    while True:
        nxt = fronts[-1].join(step.select("scope", F.col("node").alias("top"), F.col("parent").alias("far")), ["scope", "top"]).select("scope", "node", F.col("far").alias("top")).distinct()
        front = cut_loop(nxt.join(reduce(DataFrame.unionByName, fronts), ["scope", "node", "top"], "left_anti"))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, fronts)
        fronts.append(front)
        if len(fronts) > FRONTS:
            fronts = [cut_loop(reduce(DataFrame.unionByName, fronts[:-1])), front]


def _pairs(links: DataFrame) -> DataFrame:
    """All (scope, node, top) along one or more links, by squaring: as many rounds as the longest path has binary digits."""
    pairs = cut_loop(links.select("scope", "node", F.col("parent").alias("top")).distinct())
    size = pairs.count()
    while True:
        on = pairs.select("scope", F.col("node").alias("top"), F.col("top").alias("far"))
        pairs = cut_loop(pairs.unionByName(pairs.join(on, ["scope", "top"]).select("scope", "node", F.col("far").alias("top"))).distinct())
        size, before = pairs.count(), size
        if size == before:
            return pairs


def _jumps(nodes: DataFrame, links: DataFrame) -> tuple[list[DataFrame], bool]:
    """(tables, open): table k has for each node the place 2 ** k single parents up, or the anchor on the way there.

    An anchor is a node of no parent or of several. Tables are (scope, node, up, dist, done, low): done says that up is an anchor,
    low is the least node on the way. open says that some never get to an anchor, as they run in a circle.
    """
    ups = links.groupBy("scope", "node").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
    one = F.coalesce(F.col("n"), F.lit(0)) == 1
    table = cut_loop(nodes.join(ups, ["scope", "node"], "left").select("scope", "node", F.when(one, F.col("parent")).otherwise(F.col("node")).alias("up"), one.cast("long").alias("dist"), (~one).alias("done"), F.col("node").alias("low")))
    tables, rounds = [table], table.count().bit_length() + 1
    for _ in range(rounds):
        rest = table.where("not done")
        if rest.isEmpty():
            return tables, False
        far = table.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        moved = lookup(rest, far, ["scope", "up"], nulls=False).select("scope", "node", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"))
        table = cut_loop(table.where("done").unionByName(moved))
        tables.append(table)
    return tables, not table.where("not done").isEmpty()


def _anchored(links: DataFrame, table: DataFrame) -> DataFrame:
    """(scope, node, via, parent, weight) for each link of a node with several parents: via its parent, weight steps up to an anchor."""
    joins = links.join(links.groupBy("scope", "node").count().where("count > 1"), ["scope", "node"], "left_semi").select("scope", "node", F.col("parent").alias("via"))
    end = table.where("done").select("scope", F.col("node").alias("via"), F.col("up").alias("parent"), (F.col("dist") + 1).alias("weight"))
    return lookup(joins, end, ["scope", "via"], nulls=False).where("parent is not null").select("scope", "node", "via", "parent", "weight")


def strong_sets(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(scope, node, label) of every node of links that lies in a circle, without holding a component in one task.

    Nodes of a single parent are drawn up to their anchors by pointer jumping; what never gets to one runs in a circle of single
    parents, or hangs below it. What is left joins nodes of several parents alone: one task takes a scope of it that it can hold,
    others are coloured. The nodes on the way between two anchors of one circle belong to it.
    """
    loops = cut_loop(links.where("node = parent").select("scope", "node", F.col("node").alias("label")))
    rest = cut_loop(links.where("node <> parent").select("scope", "node", "parent"))
    nodes = cut_loop(rest.select("scope", "node").unionByName(rest.select("scope", F.col("parent").alias("node"))).distinct())
    tables, runs = _jumps(nodes, rest)
    last = tables[-1]
    found = loops.limit(0)
    if runs:  # after as many steps as there are nodes, up lies on the circle and low of such a node is its least one
        on = last.where("not done").select("scope", F.col("up").alias("node")).distinct()
        found = found.unionByName(last.join(on, ["scope", "node"], "left_semi").select("scope", "node", F.col("low").alias("label")))
    edges = cut_loop(_anchored(rest, last))
    thin = cut_loop(edges.select("scope", "node", "parent").distinct())
    own = thin.where("node = parent").select("scope", "node", F.col("node").alias("label"))
    big = cut_loop(thin.groupBy("scope").count().where(F.col("count") > task_links).select("scope"))
    sets = _walk(thin.join(big, "scope", "left_anti").select("scope", F.lit("").alias("root"), "node", "parent"), "sets")
    if not big.isEmpty():
        sets = sets.unionByName(_coloured(thin.where("node <> parent").join(big, "scope", "left_semi")))
    sets = cut_loop(sets)
    sets = cut_loop(sets.unionByName(own.join(sets, ["scope", "node"], "left_anti")))
    a = sets.select("scope", "node", F.col("label").alias("la"))
    b = sets.select("scope", F.col("node").alias("parent"), F.col("label").alias("lb"))
    marks = cut_loop(edges.where("via <> parent").join(a, ["scope", "node"]).join(b, ["scope", "parent"]).where("la = lb").select("scope", F.col("via").alias("node"), F.col("la").alias("label")).distinct())
    if not marks.isEmpty():
        for table in tables:  # all places on the way up to the anchor
            up = table.where("dist > 0").select("scope", "node", "up").join(marks, ["scope", "node"]).select("scope", F.col("up").alias("node"), "label")
            marks = cut_loop(marks.unionByName(up).distinct())
        sets = sets.unionByName(marks.join(sets, ["scope", "node"], "left_anti"))
    found = cut_loop(found.unionByName(sets))
    return cut_loop(found.unionByName(loops.join(found, ["scope", "node"], "left_anti")))


def _coloured(rest: DataFrame) -> DataFrame:
    """The same for links that no task can hold: each node takes the greatest name that reaches it, the nodes that reach the owner
    of their name within the same name form its circle and leave, until nothing is left."""
    found = None
    rest = cut_loop(rest.select("scope", "node", "parent"))
    while True:
        while True:  # peel off what has nothing above or below
            heads, tails = rest.select("scope", F.col("parent").alias("node")), rest.select("scope", F.col("node").alias("parent"))
            kept = cut_loop(rest.join(heads.distinct(), ["scope", "node"], "left_semi").join(tails.distinct(), ["scope", "parent"], "left_semi"))
            same = kept.count() == rest.count()
            rest = kept
            if same:
                break
        if rest.isEmpty():
            break
        color = cut_loop(rest.select("scope", "node").unionByName(rest.select("scope", F.col("parent").alias("node"))).distinct().withColumn("color", F.col("node")))
        while True:  # greatest name among the nodes that lead here
            offer = rest.join(color, ["scope", "node"]).groupBy("scope", F.col("parent").alias("node")).agg(F.max("color").alias("offer"))
            nxt = cut_loop(color.join(offer, ["scope", "node"], "left").select("scope", "node", F.greatest("color", "offer").alias("color"), (F.coalesce("offer", "color") > F.col("color")).alias("moved")))
            color = nxt.drop("moved")
            if nxt.where("moved").isEmpty():
                break
        inner = cut_loop(
            rest.join(color.withColumnRenamed("color", "cn"), ["scope", "node"])
            .join(color.select("scope", F.col("node").alias("parent"), F.col("color").alias("cp")), ["scope", "parent"])
            .where("cn = cp")
            .select("scope", "node", "parent", F.col("cn").alias("top"))
        )
        owners = color.where("node = color").select("scope", "node", F.col("color").alias("top"))
        circle = _within(owners, inner)
        real = circle.join(circle.groupBy("scope", "label").count().where("count > 1"), ["scope", "label"], "left_semi").select("scope", "node", "label")
        found = real if found is None else found.unionByName(real)
        gone = circle.select("scope", "node")
        rest = cut_loop(rest.join(gone, ["scope", "node"], "left_anti").join(gone.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_anti"))
    return found if found is not None else rest.select("scope", "node", F.col("node").alias("label"))


def _within(owners: DataFrame, inner: DataFrame) -> DataFrame:
    """(scope, node, label): who reaches the owner of a colour within it."""
    circle = front = cut_loop(owners.select("scope", "node", F.col("top").alias("label")))
    while True:
        nxt = inner.join(front.select("scope", F.col("node").alias("parent"), "label"), ["scope", "parent"]).select("scope", "node", "label").distinct()
        front = cut_loop(nxt.join(circle, ["scope", "node", "label"], "left_anti"))
        if front.isEmpty():
            return circle
        circle = cut_loop(circle.unionByName(front))


def _summed(nodes: DataFrame, heads: DataFrame, size: DataFrame, task_links: int) -> DataFrame:
    """(scope, head, depth, roots, n_paths, below) of each place: places of a single parent follow from their anchor by pointer jumping."""
    tables, _ = _jumps(nodes, heads)
    last = tables[-1]
    edges = cut_loop(_anchored(heads, last).groupBy("scope", "node", "parent", "weight").agg(F.count("*").alias("times")))
    tops = nodes.join(heads.select("scope", "node").distinct(), ["scope", "node"], "left_anti")
    known = cut_loop(tops.select("scope", "node", F.lit(0).cast("long").alias("depth"), F.array("node").alias("roots"), F.lit(1.0).alias("n_paths")))
    done, waiting = [known], edges
    while not waiting.isEmpty():  # places of several parents, from the top; only they take rounds
        blocked = waiting.select("scope", F.col("node").alias("parent")).distinct()
        ready = waiting.select("scope", "node").distinct().join(waiting.join(blocked, ["scope", "parent"], "left_semi").select("scope", "node").distinct(), ["scope", "node"], "left_anti")
        all_known = reduce(DataFrame.unionByName, done).withColumnRenamed("node", "parent")
        now = cut_loop(
            waiting.join(ready, ["scope", "node"], "left_semi").join(all_known, ["scope", "parent"])
            .groupBy("scope", "node").agg(F.max(F.col("depth") + F.col("weight")).alias("depth"), F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"), F.sum(F.col("n_paths") * F.col("times")).alias("n_paths"))
        )
        done.append(now)
        if len(done) > FRONTS:
            done = [cut_loop(reduce(DataFrame.unionByName, done))]
        waiting = cut_loop(waiting.join(now, ["scope", "node"], "left_anti"))
    known = cut_loop(reduce(DataFrame.unionByName, done))
    at = lookup(last.select("scope", "node", "up", "dist"), known.withColumnRenamed("node", "up"), ["scope", "up"], nulls=False)
    place = at.select("scope", F.col("node").alias("head"), (F.col("depth") + F.col("dist")).cast("int").alias("depth"), F.array_sort("roots").alias("roots"), "n_paths")
    if edges.isEmpty():  # trees: sums over 2 ** k steps at a time
        below = cut_loop(size.withColumn("below", F.lit(0).cast("long")))
        for k, table in enumerate(tables):
            more = table.where(F.col("dist") == 2**k).join(below, ["scope", "node"]).groupBy("scope", F.col("up").alias("node")).agg(F.sum(F.col("below") + F.col("size")).alias("more"))
            below = cut_loop(below.join(more, ["scope", "node"], "left").select("scope", "node", "size", (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
        counts = below.select("scope", F.col("node").alias("head"), "below")
    else:
        counts = _pairs(heads).join(size, ["scope", "node"]).groupBy("scope", F.col("top").alias("head")).agg(F.sum("size").alias("below"))
    return place.join(counts, ["scope", "head"], "left")


def _large(grouped: DataFrame, kind: str, bad: DataFrame, task_links: int) -> DataFrame:
    """The same results as _walk for components above the bound, by joins alone; bad (scope, root) are those that may hold circles."""
    links = cut_loop(grouped.where("parent is not null").select("scope", "root", "node", "parent").distinct())
    circle = strong_sets(links.join(bad, ["scope", "root"], "left_semi").drop("root"), task_links)
    if kind == "circles":
        return circle.select("scope", "node")
    nodes = cut_loop(grouped.select("scope", "root", "node").unionByName(links.select("scope", "root", F.col("parent").alias("node"))).distinct())
    least = circle.groupBy("scope", "label").agg(F.min("node").alias("circle"))
    of = cut_loop(nodes.join(circle.join(least, ["scope", "label"]).select("scope", "node", "circle"), ["scope", "node"], "left").select("scope", "root", "node", "circle", F.coalesce("circle", "node").alias("head")))
    up = of.select("scope", F.col("node").alias("parent"), F.col("head").alias("top"))
    heads = links.join(of.select("scope", "node", "head"), ["scope", "node"]).join(up, ["scope", "parent"]).where("head <> top")
    heads = cut_loop(heads.select("scope", "root", F.col("head").alias("node"), F.col("top").alias("parent")).distinct())
    if kind == "nodes":
        several = cut_loop(heads.groupBy("scope", "root", "node").count().where("count > 1").select("scope", "root").distinct())
        places = of.select("scope", "root", F.col("head").alias("node")).groupBy("scope", "root", "node").agg(F.count("*").alias("size"))
        out = None
        for how in ("left_anti", "left_semi"):  # trees, and components in which some place has several parents
            part = cut_loop(places.join(several, ["scope", "root"], how).drop("root"))
            if part.isEmpty():
                continue
            one = _summed(part.select("scope", "node"), heads.join(several, ["scope", "root"], how).drop("root"), part, task_links)
            out = one if out is None else out.unionByName(one)
        sized = places.select("scope", F.col("node").alias("head"), "size")
        count = F.coalesce("below", F.lit(0)) + F.when(F.col("circle").isNotNull(), F.col("size")).otherwise(0)
        return of.join(out, ["scope", "head"]).join(sized, ["scope", "head"]).select("scope", "node", F.col("circle").isNotNull().alias("in_circle"), "circle", "depth", "roots", "n_paths", count.cast("long").alias("n_descendants"))
    if kind == "descendants":
        lower = _pairs(heads).select("scope", F.col("node").alias("low"), F.col("top").alias("head"))
        own = of.where("circle is not null").select("scope", F.col("head").alias("low"), "head").distinct()
        return lower.unionByName(own).join(of.select("scope", "node", "head"), ["scope", "head"]).join(of.select("scope", F.col("node").alias("descendant"), F.col("head").alias("low")), ["scope", "low"]).select("scope", "node", "descendant")
    tops = of.select("scope", F.col("head").alias("node")).distinct().join(heads, ["scope", "node"], "left_anti")
    trails = cut_loop(tops.select("scope", F.col("node").alias("at"), F.col("node").alias("root"), F.array("node").alias("path")))
    done = [trails]
    while not trails.isEmpty():  # every path is a row of the result, so they are listed
        trails = cut_loop(trails.join(heads.select("scope", F.col("node").alias("low"), F.col("parent").alias("at")), ["scope", "at"]).select("scope", F.col("low").alias("at"), "root", F.concat("path", F.array("low")).alias("path")))
        done.append(trails)
        if len(done) > FRONTS:
            done = [cut_loop(reduce(DataFrame.unionByName, done))]
    out = reduce(DataFrame.unionByName, done)
    full = out.join(of.select("scope", "node", F.col("head").alias("at"), "circle"), ["scope", "at"])
    marks = of.where("circle is not null").select("scope", F.col("head").alias("step")).distinct()
    steps = out.select("scope", "at", "path", F.explode("path").alias("step")).join(marks, ["scope", "step"], "left_semi").select("scope", "path").distinct().withColumn("hit", F.lit(True))
    last = F.concat(F.slice("path", F.lit(1), F.size("path") - 1), F.array("node"))
    return full.join(steps, ["scope", "path"], "left").select("scope", "node", "root", last.alias("path"), (F.size("path") - 1).cast("int").alias("depth"), F.coalesce("hit", F.lit(False)).alias("through_circle"))


# ------------------------------------------------------------------ operators


def hierarchy(rows: DataFrame, kind: str, scope: str = "manifest_id", node: str = "id", parents: str = "dependencies", task_links: int = TASK_LINKS) -> DataFrame:
    """kind 'circles', 'nodes', 'descendants' or 'paths' of the hierarchy in rows; columns scope and those of SHAPES.

    A circle counts as one place: depth is the greatest number of places above a node, a path runs from a root place to
    the node and names a circle by its least node; a circle with nothing above is a root. Every member of a circle is its
    own descendant.
    """
    nodes, links = node_links(rows, scope, node, parents)
    links = cut(links)
    sets = cut(components(links, task_links))
    bad = sets.where("conflict").select("scope", "root").distinct()
    if kind == "circles":  # offsets without contradiction prove that a component has no circle
        sets = sets.where("conflict")
    grouped = links.join(sets.select("scope", "node", "root"), ["scope", "node"]).select("scope", "root", "node", "parent")
    large = grouped.groupBy("scope", "root").count().where(F.col("count") > task_links)
    large = cut(large.select("scope", "root"))
    if kind != "circles":
        lone = nodes.join(sets, ["scope", "node"], "left_anti").select("scope", F.col("node").alias("root"), "node", F.lit(None).cast("string").alias("parent"))
        grouped = grouped.unionByName(lone)
    if large.isEmpty():
        return _walk(grouped, kind)
    grouped = cut(grouped)
    small = grouped.join(large, ["scope", "root"], "left_anti")
    return _walk(small, kind).unionByName(_large(grouped.join(large, ["scope", "root"], "left_semi"), kind, bad, task_links))
