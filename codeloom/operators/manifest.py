"""Matching entities to the subsystems of manifests, with candidates, coverage, roll-ups and write-back.

subsystems: manifest_id, id, name, domain, status, file_path, interfaces, operations, tables, events, dependencies,
parent_id, depth, dfs_ord. entities: manifest_id and the columns of tables.entities. Everything joins within a manifest; for a
single one the id is a constant. Null lists count as empty. dfs_ord decides between subsystems that fit equally well.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.runtime import broadcast_if_small, cut

#: Characters on which names meet before they are compared.
GRAM = 4


def flatten(manifest: dict | str) -> list[dict]:
    """The subsystems of one manifest in depth-first order, parents first; unknown fields are ignored, an unknown status is an error."""
    data = json.loads(manifest) if isinstance(manifest, str) else manifest
    out: list[dict] = []
    todo = [(s, None, 0) for s in reversed(data.get("subsystems") or [])]
    while todo:
        sub, parent, depth = todo.pop()
        status = str(sub["status"]).lower()
        if status not in ("built", "rebuild", "new", "boilerplate"):
            raise ValueError(f"unknown status {sub['status']!r}")
        lists = {k: list(sub.get(k) or []) for k in ("interfaces", "operations", "tables", "events", "dependencies")}
        out.append({"id": sub["id"], "name": sub["name"], "domain": sub.get("domain") or "", "status": status, "file_path": (sub.get("filePath") or "").replace("\\", "/"), **lists, "parent_id": parent, "depth": depth, "dfs_ord": len(out)})
        todo += [(c, sub["id"], depth + 1) for c in reversed(sub.get("children") or [])]
    return out


def by_path(entities: DataFrame, subsystems: DataFrame, root: str = "") -> DataFrame:
    """(manifest_id, file, subsystem_id, …): for each file the subsystem with the deepest path above it.

    Paths that are no globs join on the ancestors of the file, so the join is one on equal keys; only globs are compared one by
    one, within their manifest. A relative path starts at root.
    """
    at = F.when(F.startswith("file_path", F.lit("/")) | (F.lit(root) == ""), F.col("file_path")).otherwise(F.concat_ws("/", F.lit(root), F.when(F.col("file_path") != ".", F.col("file_path"))))
    subs = subsystems.where("coalesce(file_path, '') <> ''").select("manifest_id", F.col("id").alias("subsystem_id"), F.col("name").alias("subsystem_name"), "dfs_ord", paths.trimmed(at).alias("at"))
    subs = subs.withColumn("specificity", paths.depth(F.col("at")))
    files = entities.select("manifest_id", "file").distinct()
    plain = files.withColumn("at", F.explode(paths.ancestors(F.col("file")))).join(subs.where(~paths.is_glob(F.col("at"))), ["manifest_id", "at"])
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("at", r"([.+^$()|\\])", r"\\$1"), r"\*+", ".*"), r"\?", "."), F.lit("$"))
    globs = broadcast_if_small(subs.where(paths.is_glob(F.col("at"))).withColumn("pattern", pattern))
    fits = files.join(globs, "manifest_id").where(F.expr("file rlike pattern"))
    found = plain.select("manifest_id", "file", "subsystem_id", "subsystem_name", "dfs_ord", "specificity").unionByName(fits.select("manifest_id", "file", "subsystem_id", "subsystem_name", "dfs_ord", "specificity"))
    best = found.groupBy("manifest_id", "file").agg(F.min(F.struct((-F.col("specificity")).alias("s"), "dfs_ord", "subsystem_id", "subsystem_name")).alias("b"))
    return best.select("manifest_id", "file", "b.subsystem_id", "b.subsystem_name")


def by_name(entities: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(manifest_id, name, kind, subsystem_id, subsystem_name): the first subsystem that lists the entity's name.

    Interfaces and events list it as it is, operations as it is or followed by (), tables for schemas only.
    """
    listed = lambda column, kind, name=F.col("n"): subsystems.select("manifest_id", F.col("id").alias("subsystem_id"), F.col("name").alias("subsystem_name"), "dfs_ord", F.explode(column).alias("n")).select("manifest_id", "subsystem_id", "subsystem_name", "dfs_ord", name.alias("entity"), F.lit(kind).alias("only"))
    table = listed("interfaces", None).unionByName(listed("operations", None)).unionByName(listed("operations", None, F.regexp_replace("n", r"\(\)$", ""))).unionByName(listed("events", None)).unionByName(listed("tables", "schema"))
    wanted = entities.select("manifest_id", F.col("name").alias("entity"), "kind").distinct()
    hits = wanted.join(table, ["manifest_id", "entity"]).where("only is null or only = kind")
    best = hits.groupBy("manifest_id", "entity", "kind").agg(F.min(F.struct("dfs_ord", "subsystem_id", "subsystem_name")).alias("b"))
    return best.select("manifest_id", F.col("entity").alias("name"), "kind", "b.subsystem_id", "b.subsystem_name")


def match(entities: DataFrame, subsystems: DataFrame, root: str = "") -> DataFrame:
    """entities with subsystem_id, subsystem_name and match_strategy ('file_path', else 'name_match', else null)."""
    a = by_path(entities, subsystems, root).withColumnsRenamed({"subsystem_id": "path_id", "subsystem_name": "path_name"})
    b = by_name(entities, subsystems).withColumnsRenamed({"subsystem_id": "name_id", "subsystem_name": "name_name"})
    joined = entities.join(a, ["manifest_id", "file"], "left").join(b, ["manifest_id", "name", "kind"], "left")
    strategy = F.when(F.col("path_id").isNotNull(), "file_path").when(F.col("name_id").isNotNull(), "name_match")
    return joined.select(*[F.col(c) for c in entities.columns], F.coalesce("path_id", "name_id").alias("subsystem_id"), F.coalesce("path_name", "name_name").alias("subsystem_name"), strategy.alias("match_strategy"))


def coverage(matched: DataFrame) -> DataFrame:
    """(total_entities, n_matched, coverage_percent); 100 where there are no entities."""
    hit = F.count_if(F.col("subsystem_id").isNotNull())
    return matched.agg(F.count("*").alias("total_entities"), hit.alias("n_matched")).withColumn("coverage_percent", F.when(F.col("total_entities") == 0, 100.0).otherwise(F.col("n_matched") * 100.0 / F.col("total_entities")))


def _parts_of(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(n, h) of the texts n of needles that are a part of a text h of hay.

    A needle begins with one of the parts of GRAM characters of a text it is a part of, or is such a shorter part itself; they meet on it.
    """
    lengths = sorted(r[0] for r in needles.select(F.least(F.length("n"), F.lit(GRAM))).distinct().collect())  # at most GRAM rows
    text = F.col("h")
    cuts = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[cuts(k) for k in lengths]))
    return needles.withColumn("g", F.substring("n", 1, GRAM)).join(hay.withColumn("g", F.explode(grams)), "g").where(F.contains("h", F.col("n"))).select("n", "h")


def candidates(unmatched: DataFrame, subsystems: DataFrame) -> DataFrame:
    """(manifest_id, name, candidates): subsystems of the manifest of whose id or name the entity's name is a part, or the other way round, in any case.

    Distinct texts are compared once, whatever manifests they are in, and only those that meet on a part; empty texts are part of none.
    """
    ents = unmatched.select("manifest_id", "name", F.lower("name").alias("e")).where("name <> '' and manifest_id is not null").distinct()
    labels = subsystems.select("manifest_id", "id", F.explode(F.array_distinct(F.array(F.lower("id"), F.lower("name")))).alias("s")).where("s <> '' and manifest_id is not null").distinct()
    words, shown = cut(ents.select("e").distinct()), cut(labels.select("s").distinct())
    inside = _parts_of(shown.select(F.col("s").alias("n")), words.select(F.col("e").alias("h"))).select(F.col("h").alias("e"), F.col("n").alias("s"))
    around = _parts_of(words.select(F.col("e").alias("n")), shown.select(F.col("s").alias("h"))).select(F.col("n").alias("e"), F.col("h").alias("s"))
    met = inside.unionByName(around).distinct()
    return met.join(ents, "e").join(labels, ["manifest_id", "s"]).groupBy("manifest_id", "name").agg(F.array_sort(F.collect_set("id")).alias("candidates"))


def rollup(subsystems: DataFrame, matched: DataFrame) -> DataFrame:
    """Per subsystem, in depth-first order: matched entities in all and by kind, children and dependencies; zeros where nothing fits."""
    kinds = {"interface_count": ("interface",), "operation_count": ("function", "method"), "table_count": ("schema",)}
    counts = matched.where("subsystem_id is not null").groupBy("manifest_id", F.col("subsystem_id").alias("id")).agg(F.count("*").alias("matched_entity_count"), *[F.count_if(F.col("kind").isin(*v)).alias(k) for k, v in kinds.items()])
    kids = subsystems.where("parent_id is not null").groupBy("manifest_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("child_count"))
    base = subsystems.select("manifest_id", "id", "name", "domain", "status", "dfs_ord", F.coalesce(F.size("dependencies"), F.lit(0)).alias("dependency_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return base.join(counts, ["manifest_id", "id"], "left").join(kids, ["manifest_id", "id"], "left").select("manifest_id", "id", "name", "domain", "status", "dfs_ord", zero("matched_entity_count"), *[zero(k) for k in kinds], F.lit(0).cast("long").alias("event_count"), zero("child_count"), "dependency_count")


def domain_children(subsystems: DataFrame) -> DataFrame:
    """(manifest_id, id, siblings): other subsystems of the same domain."""
    return subsystems.select("manifest_id", "id", (F.count("*").over(Window.partitionBy("manifest_id", "domain")) - 1).alias("siblings"))


def write_back(subsystems: DataFrame, matched: DataFrame) -> DataFrame:
    """subsystems with matched names added to their lists: interfaces, functions and methods as name(), schemas as tables; nothing is taken away."""
    add = lambda kinds, name: F.collect_set(F.when(F.col("kind").isin(*kinds), name))
    new = matched.where("subsystem_id is not null").groupBy("manifest_id", F.col("subsystem_id").alias("id")).agg(add(("interface",), F.col("name")).alias("i"), add(("function", "method"), F.concat("name", F.lit("()"))).alias("o"), add(("schema",), F.col("name")).alias("t"))
    joined = subsystems.join(new, ["manifest_id", "id"], "left")
    merged = lambda old, more: F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.array_sort(F.coalesce(more, F.array().cast("array<string>"))))
    return joined.withColumns({"interfaces": merged(F.col("interfaces"), F.col("i")), "operations": merged(F.col("operations"), F.col("o")), "tables": merged(F.col("tables"), F.col("t"))}).drop("i", "o", "t")
