"""Filters and lookups over entity tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import tables


@dataclass
class Filters:
    """All that is set has to hold; an unset one holds for all. The name is a case-sensitive part of the entity's name."""

    languages: list[str] = field(default_factory=list)
    name: str | None = None
    kinds: list[str] = field(default_factory=list)
    build_status: str | None = None
    visibility: str | None = None
    path_prefix: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.path_prefix is not None:
            out &= paths.has_prefix(F.col("file"), F.lit(self.path_prefix))
        if self.languages:
            out &= F.col("language").isin(self.languages)
        if self.build_status is not None:
            out &= F.col("build_status") == self.build_status
        if self.kinds:
            out &= F.col("kind").isin(self.kinds)
        if self.name is not None:
            out &= F.contains(F.col("name"), F.lit(self.name))
        if self.visibility is not None:
            out &= F.col("visibility").isNull() | (F.col("visibility") == self.visibility)
        return out


def summaries(entities: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Entity rows that fit; visibility only decides for interfaces, classes, functions and aliases."""
    return entities.where((filters or Filters()).condition())


def search(entities: DataFrame, text: str, kinds: str | None = None) -> DataFrame:
    """Entities whose name holds text; of a comma list of kinds unknown ones are dropped, and none left means all."""
    known = [k.strip() for k in (kinds or "").split(",") if k.strip() in {x[0] for x in tables.KINDS.values()}]
    return summaries(entities, Filters(name=text, kinds=known))


def by_name(ir: DataFrame, column: str, name: str) -> DataFrame:
    """Entities of one array by exact name, with their file."""
    return ir.select(F.col("path").alias("in_file"), F.explode(column).alias("e")).where(F.col("e.name") == name).select("in_file", "e.*")


def services(ir: DataFrame, kind: str | None = None) -> DataFrame:
    rows = ir.select(F.explode("services").alias("e")).select("e.*")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def methods_by_owner(methods: DataFrame, owner: str) -> DataFrame:
    """Methods of classes and implementations of that name; services are not owners here."""
    return methods.where((F.col("owner_name") == owner) & (F.col("owner_kind") != "service"))


def implementations(ir: DataFrame, trait: str) -> DataFrame:
    return ir.select(F.explode("implementations").alias("e")).select("e.*").where(F.col("trait_name") == trait)


def implementors(edges: DataFrame) -> DataFrame:
    """(interface_name, implementors): names in order, repeated ones kept."""
    return edges.groupBy("interface_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_kind", "impl_file", "ord", "implementor"))), lambda x: x.getField("implementor")).alias("implementors"))


def schemas(ir: DataFrame, framework: str | None = None, kind: str | None = None) -> DataFrame:
    rows = ir.select(F.explode("schemas").alias("e")).select("e.*")
    rows = rows if framework is None else rows.where(F.col("source_framework") == framework)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def detail(entities: DataFrame) -> DataFrame:
    """One row per (name, file): of several kinds the last, of several of a kind the last."""
    last = Window.partitionBy("name", "file").orderBy(F.desc("kind_ord"), F.desc("ent_ord"))
    return entities.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges (source, target) whose both ends are among visible (id)."""
    ids = visible.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def subsystem_filter(subsystems: DataFrame, domain: str | None = None, status: str | None = None, text: str | None = None) -> DataFrame:
    out = subsystems
    if domain:
        out = out.where(F.col("domain") == domain)
    if status:
        out = out.where(F.col("status") == status)
    if text:
        out = out.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("id"), F.lit(text.lower())))
    return out


def interfaces(ir: DataFrame, name: str | None = None, show_methods: bool = False) -> DataFrame:
    """(name, file, language_kind, visibility, n_methods), with show_methods the names of the methods as well."""
    rows = ir.select(F.col("path").alias("in_file"), F.explode("interfaces").alias("e"))
    rows = rows if name is None else rows.where(F.contains(F.col("e.name"), F.lit(name)))
    shown = [F.transform("e.methods", lambda m: m.getField("name")).alias("methods")] if show_methods else []
    return rows.select(F.col("e.name").alias("name"), F.col("in_file").alias("file"), F.col("e.language_kind").alias("language_kind"), F.col("e.visibility").alias("visibility"), F.size("e.methods").alias("n_methods"), *shown)


def service_table(ir: DataFrame, kind: str | None = None, show_routes: bool = False, show_dependencies: bool = False) -> DataFrame:
    """(name, file, kind, n_methods), with the routes as 'VERB path' and the dependencies where asked for."""
    rows = ir.select(F.col("path").alias("in_file"), F.explode("services").alias("e"))
    rows = rows if kind is None else rows.where(F.col("e.kind") == kind)
    more = [F.transform("e.routes", lambda r: F.concat_ws(" ", r.getField("method"), r.getField("path"))).alias("routes")] if show_routes else []
    more += [F.col("e.dependencies").alias("dependencies")] if show_dependencies else []
    return rows.select(F.col("e.name").alias("name"), F.col("in_file").alias("file"), F.col("e.kind").alias("kind"), F.size("e.methods").alias("n_methods"), *more)


def impl_table(ir: DataFrame, trait: str | None = None, show_methods: bool = False) -> DataFrame:
    """(target, trait_name, file, n_methods) of all implementations, or of those of one trait."""
    rows = ir.select(F.col("path").alias("in_file"), F.explode("implementations").alias("e"))
    rows = rows if trait is None else rows.where(F.col("e.trait_name") == trait)
    shown = [F.transform("e.methods", lambda m: m.getField("name")).alias("methods")] if show_methods else []
    return rows.select(F.col("e.target").alias("target"), F.col("e.trait_name").alias("trait_name"), F.col("in_file").alias("file"), F.size("e.methods").alias("n_methods"), *shown)


def method_filter(methods: DataFrame, owner: str | None = None, name: str | None = None, is_async: bool | None = None, visibility: str | None = None) -> DataFrame:
    """Rows of tables.methods for which all that is set holds; the owner is exact, the name a part."""
    out = methods
    if owner is not None:
        out = out.where(F.col("owner_name") == owner)
    if name is not None:
        out = out.where(F.contains("name", F.lit(name)))
    if is_async is not None:
        out = out.where(F.col("is_async") == is_async)
    return out if visibility is None else out.where(F.col("visibility") == visibility)


def file_by_path(ir: DataFrame, path: str) -> DataFrame:
    """The record of one file; a partition or row-group filter where the store has one."""
    return ir.where(F.col("path") == path)


def subsystem(subsystems: DataFrame, ident: str) -> DataFrame:
    """Subsystems of an id, one per manifest that has it."""
    return subsystems.where(F.col("id") == ident)


def subsystem_entities(matched: DataFrame, subsystems: DataFrame, nested: bool = False) -> DataFrame:
    """(manifest_id, id, name, kind, file, line): the entities matched to each subsystem; nested counts those of its direct children as well."""
    of = matched.where("subsystem_id is not null").select("manifest_id", F.col("subsystem_id").alias("id"), "name", "kind", "file", "line")
    own = of.join(subsystems.select("manifest_id", "id").distinct(), ["manifest_id", "id"], "left_semi")
    if not nested:
        return own
    up = subsystems.where("parent_id is not null").select("manifest_id", "id", F.col("parent_id").alias("up")).distinct()
    return own.unionByName(own.join(up, ["manifest_id", "id"]).select("manifest_id", F.col("up").alias("id"), "name", "kind", "file", "line"))


def build_status_map(ir: DataFrame) -> DataFrame:
    """(path, build_status) of each file."""
    return ir.select("path", "build_status").distinct()


def coverage_class(percent: Column) -> tuple[Column, Column]:
    """(percent of at most 100, null as 0, and its class: high from 80, medium from 50, else low)."""
    clamped = F.least(F.coalesce(percent.cast("double"), F.lit(0.0)), F.lit(100.0))
    return clamped, F.when(clamped >= 80, "high").when(clamped >= 50, "medium").otherwise("low")
