"""Ten quality rules over records of files, and naming and reference rules over manifests.

Each rule gives violations (rule, severity, message, entity_name, file, line). Rules run in the order asked for; unknown
names are skipped and not counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import resolve, tables

GOD_INTERFACE, GOD_SERVICE = 10, 15


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _finding_of(rule: str, severity: str, message: Column, entity: Column, line: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"), entity.alias("entity_name"), F.col("path").alias("file"), line.cast("int").alias("line"))


def _per(column: str, fits, finding) -> Column:
    """Findings of the entities of one array for which fits holds; both take the entity, its place and the array."""
    array = F.coalesce(F.col(column), F.array())
    return F.filter(F.transform(array, lambda e, i: F.when(fits(e, i, array), finding(e))), lambda x: x.isNotNull())


def _line(e: Column) -> Column:
    return e.getField("span").getField("start_line")


def _again(e: Column, i: Column, array: Column) -> Column:
    """Whether an earlier element has the same name."""
    return F.array_position(F.transform(array, lambda x: x.getField("name")), e.getField("name")) <= i


def _naming(column: str, kind: str) -> Column:
    rule, label = "methods-naming-convention", names.convention(F.col("language"))
    def of(e: Column) -> Column:
        wrong = F.filter(e.getField("methods"), lambda m: ~names.follows_convention(m.getField("name"), F.col("language")))
        return F.transform(wrong, lambda m: _finding_of(rule, "warn", _text("Method '", m.getField("name"), f"' in {kind} '", e.getField("name"), "' doesn't follow ", label, " naming convention"), m.getField("name"), _line(m)))
    return F.flatten(F.transform(F.coalesce(F.col(column), F.array()), of))


def _duplicate_methods() -> Column:
    def of(e: Column) -> Column:
        held = e.getField("methods")
        found = F.transform(held, lambda m, i: F.when(_again(m, i, held), _finding_of("no-duplicate-method-names", "fail", _text("Duplicate method '", m.getField("name"), "' in interface '", e.getField("name"), "'"), m.getField("name"), _line(m))))
        return F.filter(found, lambda x: x.isNotNull())
    return F.flatten(F.transform(F.coalesce(F.col("interfaces"), F.array()), of))


def _untyped_fields() -> Column:
    def of(e: Column) -> Column:
        bare = F.filter(e.getField("fields"), lambda f: f.getField("type_annotation").isNull())
        return F.transform(bare, lambda f: _finding_of("schema-fields-have-types", "warn", _text("Field '", f.getField("name"), "' in schema '", e.getField("name"), "' has no type annotation"), e.getField("name"), _line(e)))
    return F.flatten(F.transform(F.coalesce(F.col("schemas"), F.array()), of))


def _sized(column: str, rule: str, severity: str, fits, *message) -> Column:
    return _per(column, lambda e, i, a: fits(e), lambda e: _finding_of(rule, severity, _text(*[p(e) if callable(p) else p for p in message]), e.getField("name"), _line(e)))


_NAME = lambda e: e.getField("name")
_SIZE = lambda f: lambda e: F.size(e.getField(f))
# The rules' names and messages as users know them.
LOCAL = {
    "interfaces-pascal-case": lambda: _sized("interfaces", "interfaces-pascal-case", "warn", lambda e: ~names.is_pascal(_NAME(e)), "Interface '", _NAME, "' is not PascalCase"),
    "methods-naming-convention": lambda: F.concat(_naming("classes", "class"), _naming("interfaces", "interface")),
    "no-duplicate-interface-names": lambda: _per("interfaces", _again, lambda e: _finding_of("no-duplicate-interface-names", "fail", _text("Duplicate interface name '", _NAME(e), "' in same file"), _NAME(e), _line(e))),
    "no-duplicate-method-names": _duplicate_methods,
    "interfaces-have-methods": lambda: _sized("interfaces", "interfaces-have-methods", "warn", lambda e: (_SIZE("methods")(e) == 0) & (_SIZE("properties")(e) == 0), "Interface '", _NAME, "' has no methods or properties"),
    "services-have-methods": lambda: _sized("services", "services-have-methods", "warn", lambda e: (_SIZE("methods")(e) == 0) & (_SIZE("routes")(e) == 0), "Service '", _NAME, "' has no methods or routes"),
    "schema-fields-have-types": _untyped_fields,
    "no-god-interfaces": lambda: _sized("interfaces", "no-god-interfaces", "warn", lambda e: _SIZE("methods")(e) > GOD_INTERFACE, "Interface '", _NAME, "' has ", _SIZE("methods"), f" methods (max {GOD_INTERFACE})"),
    "no-god-services": lambda: _sized("services", "no-god-services", "warn", lambda e: _SIZE("methods")(e) > GOD_SERVICE, "Service '", _NAME, "' has ", _SIZE("methods"), f" methods (max {GOD_SERVICE})"),
}
IMPLEMENTED = "interfaces-have-implementors"
RULES = (*LOCAL, IMPLEMENTED)


def without_implementors(ir: DataFrame) -> DataFrame:
    rows = ir.select("path", F.explode("interfaces").alias("e")).select(F.col("e.name").alias("name"), F.col("e.visibility").alias("visibility"), "path", F.col("e.span.start_line").alias("line"))
    rows = resolve.unimplemented(rows, tables.implements(ir))
    return rows.select(F.inline(F.array(_finding_of(IMPLEMENTED, "fail", _text("Public interface '", F.col("name"), "' has no implementors"), F.col("name"), F.col("line")))))


def violations(ir: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(rule, severity, message, entity_name, file, line). The rules that need one record each are found in one pass over the
    records; only the search for implementors joins."""
    chosen = [r for r in (RULES if rules is None else rules) if r in RULES]
    local = [LOCAL[r]() for r in chosen if r in LOCAL]
    out = ir.select(F.inline(F.concat(*local) if len(local) > 1 else local[0])) if local else None
    if IMPLEMENTED in chosen or not chosen:
        joined = without_implementors(ir)
        out = joined if out is None else out.unionByName(joined)
    return out if chosen else out.limit(0)


def summary(found: DataFrame, rules_checked: int) -> DataFrame:
    """One row: counts of warnings and failures; pass_count takes one off the rules for any failure and one for any warning."""
    warn, fail = F.count_if(F.col("severity") == "warn"), F.count_if(F.col("severity") == "fail")
    return found.agg(F.lit(rules_checked).cast("long").alias("rules_checked"), warn.alias("warn_count"), fail.alias("fail_count")).withColumn("pass_count", F.col("rules_checked") - (F.col("fail_count") > 0).cast("long") - (F.col("warn_count") > 0).cast("long"))


def exit_status(warn_count: int, fail_count: int, strict: bool = False) -> int:
    return int(fail_count > 0 or (strict and warn_count > 0))


# ------------------------------------------------------------------ manifests
# What names in a manifest have to be.
NAMING = {
    "interfaces": (names.PASCAL, "PascalCase (^[A-Z][A-Za-z0-9]*$)"), "operations": (names.OPERATION, "camelCase with () (^[a-z][A-Za-z0-9]*\\(\\)$)"),
    "tables": (names.TABLE, "snake_case (^[a-z][a-z0-9_]*$)"), "events": (names.EVENT, "dot.notation (^[a-z][a-z0-9]*(\\.[a-z][a-z0-9]*)+$)"),
}


def _finding(rows: DataFrame, field: str, value: Column, expected: Column) -> DataFrame:
    return rows.select("manifest_id", F.col("id").alias("subsystem_id"), F.lit(field).alias("field"), value.alias("value"), expected.alias("expected"))


def manifest_names(subsystems: DataFrame) -> DataFrame:
    """(manifest_id, subsystem_id, field, value, expected) for each name that breaks its form."""
    out = []
    for column, (form, expected) in NAMING.items():
        rows = subsystems.select("manifest_id", "id", F.explode(column).alias("v")).where(F.col("v").isNotNull() & ~F.col("v").rlike(form))
        out.append(_finding(rows, column, F.col("v"), F.lit(expected)))
    return reduce(DataFrame.unionByName, out)


def manifest_references(subsystems: DataFrame, domains: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """Repeated ids, empty paths, unknown domains and dependencies, domains other than the parent's, dangling connections.

    subsystems: manifest_id, id, domain, file_path, dependencies, parent_id, dfs_ord; domains: manifest_id, domain_id. A
    manifest without domains has no unknown ones. Everything is compared within its manifest.
    """
    again = resolve.duplicates_after_first(subsystems.select("manifest_id", "id", "dfs_ord"), ["manifest_id", "id"], ["dfs_ord"])
    out = [_finding(again, "id", F.col("id"), F.lit("unique subsystem id"))]
    out.append(_finding(subsystems.where("coalesce(file_path, '') = ''"), "filePath", F.lit(""), F.lit("non-empty directory path")))
    placed = subsystems.where("domain <> ''").join(domains.select("manifest_id").distinct(), "manifest_id", "left_semi")
    known = domains.select("manifest_id", F.col("domain_id").alias("domain")).distinct()
    out.append(_finding(placed.join(known, ["manifest_id", "domain"], "left_anti"), "domain", F.col("domain"), F.lit("existing domain id")))
    parents = subsystems.select("manifest_id", F.col("id").alias("parent_id"), F.col("domain").alias("parent_domain")).where("parent_domain <> ''").distinct()
    moved = subsystems.where("domain <> ''").join(parents, ["manifest_id", "parent_id"]).where("domain <> parent_domain")
    out.append(_finding(moved, "domain", F.col("domain"), F.concat(F.lit("same domain as parent ("), F.col("parent_domain"), F.lit(")"))))
    ids = subsystems.select("manifest_id", F.col("id").alias("v")).distinct()
    wanted = subsystems.select("manifest_id", "id", F.explode("dependencies").alias("v")).where("v is not null")
    out.append(_finding(wanted.join(ids, ["manifest_id", "v"], "left_anti"), "dependencies", F.col("v"), F.lit("existing subsystem id")))
    if connections is not None:
        for end in ("from", "to"):
            loose = connections.select("manifest_id", F.col(end).alias("id"), F.col(end).alias("v")).join(ids, ["manifest_id", "v"], "left_anti")
            out.append(_finding(loose, f"connections.{end}", F.col("v"), F.lit("existing subsystem id")))
    return reduce(DataFrame.unionByName, out)


def manifest_report(naming: DataFrame, references: DataFrame) -> DataFrame:
    """(manifest_id, field, n_naming, n_references, n_subsystems): findings of manifest_names and manifest_references, counted."""
    rows = naming.withColumn("kind", F.lit("naming")).unionByName(references.withColumn("kind", F.lit("reference")))
    return rows.groupBy("manifest_id", "field").agg(F.count_if(F.col("kind") == "naming").alias("n_naming"), F.count_if(F.col("kind") == "reference").alias("n_references"), F.countDistinct("subsystem_id").alias("n_subsystems"))
