"""Graph operators over subsystems and their connections: closures, layers, order along lines, positions, bundles.

connections (manifest_id, from, to): from depends on to. subsystems (manifest_id, id, domain). All is per manifest.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.hierarchy import _reach
from codeloom.runtime import cut

# Measures of a drawn map, and its colours.
STATION_GAP, LINE_GAP, PER_ROW, NODE_WIDTH = 420, 320, 10, 360
PALETTE = ("#3b82f6", "#22c55e", "#f97316", "#a855f7", "#ef4444", "#eab308", "#06b6d4", "#ec4899", "#14b8a6", "#f59e0b", "#6366f1", "#84cc16")
UNASSIGNED = "__unassigned__"
#: Connections between two domains above which they are drawn as one bundle.
BUNDLE_THRESHOLD = 3


def closure(connections: DataFrame, start: DataFrame, upstream: bool = True, downstream: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that can be reached from start (manifest_id, id) along from -> to (downstream), the other way, or both ways."""
    step = connections.select(F.col("manifest_id").alias("scope"), F.col("from").alias("node"), F.col("to").alias("parent")).distinct()
    seeds = start.select(F.col("manifest_id").alias("scope"), F.col("id").alias("node"), F.col("id").alias("top"))
    nodes, edges = seeds.select("scope", F.col("top").alias("id")), None
    for on, links in ((downstream, step), (upstream, step.select("scope", F.col("parent").alias("node"), F.col("node").alias("parent")))):
        if not on:
            continue
        found = _reach(seeds, links).select("scope", F.col("top").alias("id")).distinct()
        walked = links.join(found.withColumnRenamed("id", "node"), ["scope", "node"], "left_semi")
        if links is not step:
            walked = walked.select("scope", F.col("parent").alias("node"), F.col("node").alias("parent"))
        nodes, edges = nodes.unionByName(found), walked if edges is None else edges.unionByName(walked)
    named = edges if edges is not None else step.limit(0)
    return nodes.distinct().withColumnRenamed("scope", "manifest_id"), named.distinct().select(F.col("scope").alias("manifest_id"), F.col("node").alias("from"), F.col("parent").alias("to"))


def normalize_orphans(subsystems: DataFrame, domains: DataFrame) -> DataFrame:
    """subsystems with a domain that is empty or unknown in their manifest put into the synthetic one."""
    known = domains.select("manifest_id", F.col("domain_id").alias("domain")).distinct().withColumn("known", F.lit(True))
    return subsystems.join(known, ["manifest_id", "domain"], "left").withColumn("domain", F.when(F.col("known") & (F.col("domain") != ""), F.col("domain")).otherwise(UNASSIGNED)).drop("known")


def domain_edges(connections: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(manifest_id, before, after, weight): connections across domains, counted; what is depended on comes before."""
    a = subsystems.select("manifest_id", F.col("id").alias("from"), F.col("domain").alias("after"))
    b = subsystems.select("manifest_id", F.col("id").alias("to"), F.col("domain").alias("before"))
    both = connections.select("manifest_id", "from", "to").join(a, ["manifest_id", "from"]).join(b, ["manifest_id", "to"])
    return both.where("before <> after").groupBy("manifest_id", "before", "after").agg(F.count("*").alias("weight"))


def layer(nodes: list[str], edges: dict[tuple[str, str], int]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Depth of each node by layers of nodes without open predecessors, and the edges cut to break circles: the lightest first, then by name."""
    open_edges = {e for e in edges if e[0] != e[1]}
    left, depth, cuts, level = set(nodes), {}, [], 0
    while left:
        blocked = {b for a, b in open_edges if a in left and b in left}
        free = left - blocked
        if not free:
            lightest = min((e for e in open_edges if e[0] in left and e[1] in left), key=lambda e: (edges[e], e))
            open_edges.discard(lightest)
            cuts.append(lightest)
            continue
        depth.update(dict.fromkeys(free, level))
        left -= free
        level += 1
    return depth, cuts


def domain_layers(subsystems: DataFrame, connections: DataFrame) -> DataFrame:
    """(manifest_id, domain, topo_depth, station_count, cut): cut names the domains to which an edge was cut, joined.

    Only domains and counts between them reach a task, never subsystems.
    """
    stations = subsystems.groupBy("manifest_id", "domain").agg(F.count("*").alias("n"))
    rows = stations.select("manifest_id", F.col("domain").alias("a"), F.lit(None).cast("string").alias("b"), "n").unionByName(domain_edges(connections, subsystems).select("manifest_id", F.col("before").alias("a"), F.col("after").alias("b"), F.col("weight").alias("n")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"].isna()]
        between = pdf[pdf["b"].notna()]
        depth, cuts = layer(own["a"].tolist(), dict(zip(zip(between["a"], between["b"]), between["n"])))
        count = dict(zip(own["a"], own["n"]))
        return pd.DataFrame([(pdf["manifest_id"].iloc[0], d, k, count[d], ",".join(sorted(b for a, b in cuts if a == d))) for d, k in depth.items()], columns=["manifest_id", "domain", "topo_depth", "station_count", "cut"])

    return rows.where("a is not null").groupBy("manifest_id").applyInPandas(run, "manifest_id long, domain string, topo_depth int, station_count long, cut string")


def grid(layers: DataFrame) -> DataFrame:
    """layers with row and col: ceil(sqrt(n)) columns; domains of a depth fill rows by falling station count, each depth starts a row."""
    every = Window.partitionBy("manifest_id")
    within = Window.partitionBy("manifest_id", "topo_depth")
    ranked = layers.withColumn("cols", F.ceil(F.sqrt(F.count("*").over(every))).cast("int")).withColumn("i", F.row_number().over(within.orderBy(F.desc("station_count"), "domain")) - 1)
    rows = ranked.groupBy("manifest_id", "topo_depth").agg(F.ceil(F.count("*") / F.first("cols")).alias("n"))
    base = rows.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("manifest_id").orderBy("topo_depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranked.join(base, ["manifest_id", "topo_depth"]).select("manifest_id", "domain", "topo_depth", "station_count", (F.col("base") + F.floor(F.col("i") / F.col("cols"))).cast("int").alias("row"), F.pmod("i", "cols").alias("col"))


def station_depths(subsystems: DataFrame, connections: DataFrame) -> DataFrame:
    """(manifest_id, domain, id, topo_depth) within each domain; members of circles and what hangs on them share the depth at which no more is free."""
    dom = subsystems.select("manifest_id", "domain", "id").distinct()
    inner = connections.select("manifest_id", "from", "to").join(dom.select("manifest_id", "domain", F.col("id").alias("from")), ["manifest_id", "from"]).join(dom.select("manifest_id", "domain", F.col("id").alias("to")), ["manifest_id", "domain", "to"]).select("manifest_id", "domain", "from", "to").distinct()
    left, level, out = cut(dom), 0, None
    open_edges = cut(inner)
    while not left.isEmpty():
        blocked = open_edges.select("manifest_id", "domain", F.col("from").alias("id")).distinct()
        free = left.join(blocked, ["manifest_id", "domain", "id"], "left_anti")
        moving = free.select("manifest_id", "domain").distinct()
        stuck = left.join(moving, ["manifest_id", "domain"], "left_anti")  # a domain in which nothing is free any more
        done = cut(free.unionByName(stuck).withColumn("topo_depth", F.lit(level)))
        out = done if out is None else out.unionByName(done)
        ids = done.select("manifest_id", "domain", "id")
        left = cut(left.join(ids, ["manifest_id", "domain", "id"], "left_anti"))
        open_edges = cut(open_edges.join(ids.withColumnRenamed("id", "to"), ["manifest_id", "domain", "to"], "left_anti").join(stuck.select("manifest_id", "domain").distinct(), ["manifest_id", "domain"], "left_anti"))
        level += 1
    return out if out is not None else dom.withColumn("topo_depth", F.lit(0))


def fan_out(subsystems: DataFrame, connections: DataFrame) -> DataFrame:
    """(manifest_id, id, fan_out): ends of connections across domains at each subsystem."""
    dom = subsystems.select("manifest_id", "id", "domain").distinct()
    both = connections.join(dom.select("manifest_id", F.col("id").alias("from"), F.col("domain").alias("df")), ["manifest_id", "from"]).join(dom.select("manifest_id", F.col("id").alias("to"), F.col("domain").alias("dt")), ["manifest_id", "to"]).where("df <> dt")
    ends = both.select("manifest_id", F.explode(F.array("from", "to")).alias("id")).groupBy("manifest_id", "id").agg(F.count("*").alias("fan_out"))
    return dom.select("manifest_id", "id").distinct().join(ends, ["manifest_id", "id"], "left").select("manifest_id", "id", F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def station_order(depths: DataFrame, fans: DataFrame) -> DataFrame:
    """depths with position: the place along the domain's line by depth, fan-out and id, from 0."""
    line = Window.partitionBy("manifest_id", "domain").orderBy("topo_depth", "fan_out", "id")
    return depths.join(fans, ["manifest_id", "id"]).withColumn("position", F.row_number().over(line) - 1)


def line_offset(position: Column) -> tuple[Column, Column]:
    """(x, y) of a station from its line's origin: ten to the right, one down, ten to the left and so on."""
    row, k = F.floor(position / PER_ROW), F.pmod(position, F.lit(PER_ROW))
    return (F.when(F.pmod(row, F.lit(2)) == 0, k).otherwise(PER_ROW - 1 - k) * STATION_GAP).cast("int"), (row * LINE_GAP).cast("int")


def compact_layout(order: DataFrame, visible: DataFrame) -> DataFrame:
    """(manifest_id, id, x, y): the visible stations of station_order put close together, each line centred and below the line before.

    visible: (manifest_id, id). Stations on no line stand in a last row.
    """
    seen = visible.select("manifest_id", "id").distinct()
    shown = order.join(seen, ["manifest_id", "id"], "left_semi")
    lines = shown.groupBy("manifest_id", "domain").agg(F.count("*").alias("n"))
    lines = lines.withColumn("row", F.row_number().over(Window.partitionBy("manifest_id").orderBy("domain")) - 1).withColumn("most", F.max("n").over(Window.partitionBy("manifest_id")))
    place = F.row_number().over(Window.partitionBy("manifest_id", "domain").orderBy("position", "id")) - 1
    on = shown.withColumn("i", place).join(lines, ["manifest_id", "domain"]).select("manifest_id", "id", ((F.col("most") - F.col("n")) * STATION_GAP / 2 + F.col("i") * STATION_GAP).alias("x"), (F.col("row") * LINE_GAP).cast("int").alias("y"))
    rows = lines.groupBy("manifest_id").agg(F.count("*").alias("rows"))
    off = seen.join(order, ["manifest_id", "id"], "left_anti").withColumn("i", F.row_number().over(Window.partitionBy("manifest_id").orderBy("id")) - 1).join(rows, "manifest_id", "left")
    return on.unionByName(off.select("manifest_id", "id", (F.col("i") * (NODE_WIDTH + 40)).cast("double").alias("x"), (F.coalesce("rows", F.lit(0)) * LINE_GAP).cast("int").alias("y")))


def palette_colors(domains: DataFrame) -> DataFrame:
    """(manifest_id, domain, color): the colours in turn by sorted name."""
    rank = F.row_number().over(Window.partitionBy("manifest_id").orderBy("domain")) - 1
    return domains.select("manifest_id", "domain").distinct().withColumn("color", F.element_at(F.array(*[F.lit(c) for c in PALETTE]), F.pmod(rank, F.lit(len(PALETTE))) + 1))


def bundles(connections: DataFrame, subsystems: DataFrame, tracing: bool = False) -> DataFrame:
    """(manifest_id, from_domain, to_domain, n_edges, bundled): ordered pairs of domains; one of more than three is a bundle, never while tracing."""
    pairs = domain_edges(connections, subsystems)
    return pairs.select("manifest_id", F.col("after").alias("from_domain"), F.col("before").alias("to_domain"), F.col("weight").alias("n_edges"), (F.lit(not tracing) & (F.col("weight") > BUNDLE_THRESHOLD)).alias("bundled"))


def visible_lines(subsystems: DataFrame) -> DataFrame:
    """(manifest_id, domain) of lines with at least two stations."""
    return subsystems.groupBy("manifest_id", "domain").agg(F.countDistinct("id").alias("n")).where("n >= 2").drop("n")
