"""A manifest from a scan: directory groups, domains, subsystems, weighted connections, colours."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import names, paths
from codeloom.operators import graph
from codeloom.runtime import is_small, ranked

# Directories that hold packages, and directories that hold a package's code.
WORKSPACES = ("crates", "packages", "apps", "modules", "services", "libs", "workspaces")
CODE = ("src", "lib", "app")
#: Connections of one subsystem, and of all, that are kept.
PER_SOURCE, OVERALL = 8, 50


def group_keys(path: Column) -> tuple[Column, Column]:
    """(domain, subsystem) of a path from the root."""
    c = F.split(path, "/")
    n = F.size(c)
    at = lambda i: F.element_at(c, i + 1)
    inner = F.when(n > 3, F.when(at(2).isin(*CODE), F.when(n > 4, at(3)).otherwise(at(1))).otherwise(at(2))).otherwise(at(1))
    nested = at(0).isin(*WORKSPACES, *CODE)
    domain = F.when(n <= 1, "_root").when(n == 2, at(0)).when(nested, at(1)).otherwise(at(0))
    return domain, F.when(n <= 1, at(0)).when(n == 2, at(0)).when(nested, inner).otherwise(at(1))


def directory_groups(files: DataFrame) -> DataFrame:
    """files (path) with domain and subsystem."""
    domain, sub = group_keys(F.col("path"))
    return files.withColumn("domain", domain).withColumn("subsystem", sub)


def common_prefix(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prefix): the directories that all files of a group share, '.' for none.

    What the least and the greatest list of directories share all of them share, so two values per group are enough.
    """
    dirs = F.split(paths.parent(F.col("path")), "/")
    ends = groups.groupBy(*keys).agg(F.min(dirs).alias("lo"), F.max(dirs).alias("hi"))
    size = F.least(F.size("lo"), F.size("hi"))
    same = F.filter(F.sequence(F.lit(1), size), lambda i: F.slice("lo", F.lit(1), i) == F.slice("hi", F.lit(1), i))
    prefix = F.array_join(F.slice("lo", F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), "/")
    return ends.select(*keys, F.when(prefix == "", ".").otherwise(prefix).alias("prefix"))


def subsystems(files: DataFrame, min_files: int = 1) -> DataFrame:
    """(id, name, domain, status, file_path, n_files) for groups of at least min_files files; if there are none, one per domain."""
    groups = directory_groups(files)
    fine = groups.groupBy("domain", "subsystem").agg(F.count("*").alias("n_files")).where(F.col("n_files") >= min_files)
    ident = F.when(F.col("domain") == F.col("subsystem"), F.col("domain")).otherwise(F.concat_ws("-", "domain", "subsystem"))
    made = fine.join(common_prefix(groups, ["domain", "subsystem"]).hint("merge"), ["domain", "subsystem"]).select(ident.alias("base"), names.humanized(F.col("subsystem")).alias("name"), "domain", "prefix", "n_files")
    coarse = groups.groupBy("domain").agg(F.count("*").alias("n_files")).join(common_prefix(groups, ["domain"]).hint("merge"), "domain").select(F.col("domain").alias("base"), names.humanized(F.col("domain")).alias("name"), "domain", "prefix", "n_files")
    none = fine.limit(1).agg(F.count("*").alias("k"))
    both = made.unionByName(coarse.join(F.broadcast(none)).where("k = 0").drop("k"))
    return unique_ids(both, "base", ["domain", "prefix"]).select("id", "name", "domain", F.lit("new").alias("status"), F.col("prefix").alias("file_path"), "n_files")


def unique_ids(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """rows with id: the base, and base-2, base-3 … for repeated ones in the given order."""
    rn = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return rows.withColumn("rn", rn).withColumn("id", F.when(F.col("rn") == 1, F.col(base)).otherwise(F.concat_ws("-", base, "rn"))).drop("rn")


def path_subsystem(files: DataFrame, subs: DataFrame) -> DataFrame:
    """(path, id): the subsystem with the deepest path above a file; paths are taken as they are.

    Spark guesses the directories above all files as small as the compressed column of paths. Only the subsystems are ever
    broadcast, if they were counted to be few; else both sides are merged.
    """
    at = subs.where("coalesce(file_path, '') <> ''").select("id", paths.trimmed(F.col("file_path")).alias("at"), "ord").withColumn("deep", paths.depth(F.col("at")))
    up = files.select("path").distinct().withColumn("at", F.explode(paths.ancestors(F.col("path"))))
    best = up.join(F.broadcast(at) if is_small(at) else at.hint("merge"), "at").groupBy("path").agg(F.min(F.struct((-F.col("deep")).alias("d"), "ord", "id")).alias("b"))
    return best.select("path", F.col("b.id").alias("id"))


def import_subsystem(imports: DataFrame, subs: DataFrame) -> DataFrame:
    """imports (file, source) with to: by the normalised path of a relative source, else by the first of its parts that names a subsystem.

    A part names a subsystem by its id, its name with - or _ for blanks, or a component of its path, in any case.
    """
    numbered = imports.withColumn("uid", F.monotonically_increasing_id())
    relative = F.startswith("source", F.lit("."))
    near = numbered.where(relative).withColumn("path", paths.normalized(F.concat_ws("/", F.when(paths.parent(F.col("file")) != "", paths.parent(F.col("file"))), "source"), True))
    near = near.join(path_subsystem(near, subs).hint("merge"), "path", "left").select("file", "source", F.col("id").alias("to"))
    labels = F.array_union(F.array(F.lower("id"), F.regexp_replace(F.lower("name"), " ", "-"), F.regexp_replace(F.lower("name"), " ", "_")), F.split(F.lower("file_path"), "/"))
    keys = subs.select("id", "ord", F.explode(F.array_distinct(labels)).alias("part")).where("part <> ''").groupBy("part").agg(F.min(F.struct("ord", "id")).alias("b"))
    parts = F.filter(F.split("source", "[/:]+"), lambda p: (p != "") & ~p.isin("crate", "super", "self", "@", "src", "lib"))
    far = numbered.where(~relative).select("uid", "file", "source", F.posexplode_outer(F.transform(parts, F.lower)).alias("p", "part"))
    best = far.join(keys, "part", "left").groupBy("uid", "file", "source").agg(F.min(F.when(F.col("b").isNotNull(), F.struct("p", "b.id"))).alias("x"))
    return near.unionByName(best.select("file", "source", F.col("x.id").alias("to")))


def capped(edges: DataFrame, source: str = "from", target: str = "to", per_source: int = PER_SOURCE, overall: int = OVERALL) -> DataFrame:
    """Edges by falling weight, then names: the first of each source, and of those the first of all."""
    own = Window.partitionBy(source).orderBy(F.desc("weight"), target)
    return edges.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= per_source).drop("rn").orderBy(F.desc("weight"), source, target).limit(overall)


def connections(files: DataFrame, imports: DataFrame, subs: DataFrame) -> DataFrame:
    """(from, to, weight, label, type): imports between subsystems, counted and capped."""
    ordered = ranked(subs, [F.asc("id")], "ord") if "ord" not in subs.columns else subs  # subsystems of one manifest
    here = path_subsystem(files, ordered).withColumnsRenamed({"path": "file", "id": "from"})
    edges = import_subsystem(imports, ordered).where("to is not null").join(here.hint("merge"), "file").where("`from` <> `to`").groupBy("from", "to").agg(F.count("*").alias("weight"))
    return capped(edges).withColumn("label", F.concat_ws(" → ", "from", "to")).withColumn("type", F.lit("depends_on"))


#: Subsystems that a manifest rendered as one text may have.
MANIFEST_ROWS = 100_000


def manifest(name: str, subs: DataFrame, links: DataFrame) -> str:
    """The manifest as one JSON text, put together on the driver; more than MANIFEST_ROWS subsystems are an error. Connections are capped by nature."""
    if not is_small(subs, MANIFEST_ROWS):
        raise ValueError(f"more than {MANIFEST_ROWS} subsystems; write them with sinks.write_ndjson")
    rows = subs.orderBy("id").collect()
    domains = sorted({r["domain"] for r in rows})
    human = lambda x: " ".join(w[:1].upper() + w[1:] for w in x.replace("_", "-").split("-") if w)
    return json.dumps(
        {
            "meta": {"name": name, "version": "", "description": ""},
            "domains": {d: {"label": human(d), "color": graph.PALETTE[i % len(graph.PALETTE)]} for i, d in enumerate(domains)},
            "subsystems": [{"id": r["id"], "name": r["name"], "domain": r["domain"], "status": r["status"], "filePath": r["file_path"], "interfaces": [], "operations": [], "tables": [], "events": [], "children": [], "dependencies": []} for r in rows],
            "connections": [{"from": r["from"], "to": r["to"], "label": r["label"], "type": r["type"]} for r in links.collect()],
        },
        indent=2, ensure_ascii=False,
    )
