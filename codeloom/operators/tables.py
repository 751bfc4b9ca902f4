"""Long tables over records of files: entities, methods, fields, routes, imports, exports, edges.

Input is a DataFrame of records (schema.IR_FILE). Ordinals (kind_ord, ent_ord, …) carry the order of a file's entities;
null or empty arrays give no rows. Further columns of the input are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: array -> (kind, name, visibility); the order is that of entity lists.
KINDS: dict[str, tuple[str, Column | None, bool]] = {
    "interfaces": ("interface", None, True), "services": ("service", None, False), "classes": ("class", None, True), "functions": ("function", None, True),
    "schemas": ("schema", None, False), "implementations": ("impl", None, False), "type_aliases": ("type_alias", None, True),
}


def entities(ir: DataFrame) -> DataFrame:
    """(name, kind, file, line, language, build_status, confidence, visibility, kind_ord, ent_ord), one row per entity.

    An implementation is named '<trait> for <target>', or by its target alone. visibility is null where a kind has none
    that filters may use.
    """
    parts = []
    for order, (column, (kind, _, visible)) in enumerate(KINDS.items()):
        one = ir.select("path", "language", "build_status", "confidence", F.posexplode(column).alias("ent_ord", "e"))
        name = F.coalesce(F.concat(F.col("e.trait_name"), F.lit(" for "), F.col("e.target")), F.col("e.target")) if kind == "impl" else F.col("e.name")
        visibility = F.col("e.visibility") if visible else F.lit(None).cast("string")
        parts.append(one.select(name.alias("name"), F.lit(kind).alias("kind"), F.col("path").alias("file"), F.col("e.span.start_line").alias("line"), "language", "build_status", "confidence", visibility.alias("visibility"), F.lit(order).alias("kind_ord"), "ent_ord"))
    return reduce(DataFrame.unionByName, parts)


def _method_rows(ir: DataFrame, column: str, owner_kind: str, owner: str, order: int) -> DataFrame:
    owners = ir.select("path", "language", F.posexplode(column).alias("owner_ord", "o"))
    rows = owners.select("path", "language", "owner_ord", F.col(f"o.{owner}").alias("owner_name"), F.posexplode("o.methods").alias("method_ord", "m"))
    return rows.select(F.lit(owner_kind).alias("owner_kind"), "owner_name", F.col("path").alias("file"), "language", F.col("m.name").alias("name"), F.col("m.span.start_line").alias("line"), F.col("m.visibility").alias("visibility"), F.col("m.is_async").alias("is_async"), F.col("m.is_static").alias("is_static"), F.size("m.parameters").alias("n_parameters"), F.col("m.return_type").alias("return_type"), F.col("m.decorators").alias("decorators"), F.lit(order).alias("kind_ord"), "owner_ord", "method_ord")


def methods(ir: DataFrame) -> DataFrame:
    """Methods of classes, services and implementations, in this order per file."""
    return _method_rows(ir, "classes", "class", "name", 0).unionByName(_method_rows(ir, "services", "service", "name", 1)).unionByName(_method_rows(ir, "implementations", "impl", "target", 2))


def interface_methods(ir: DataFrame) -> DataFrame:
    """(interface, file, language, name, line, iface_line, has_default, iface_ord, method_ord)."""
    rows = ir.select("path", "language", F.posexplode("interfaces").alias("iface_ord", "i")).select("path", "language", "iface_ord", F.col("i.name").alias("interface"), F.col("i.span.start_line").alias("iface_line"), F.posexplode("i.methods").alias("method_ord", "m"))
    return rows.select("interface", F.col("path").alias("file"), "language", F.col("m.name").alias("name"), F.col("m.span.start_line").alias("line"), "iface_line", F.col("m.has_default").alias("has_default"), "iface_ord", "method_ord")


def fields(ir: DataFrame) -> DataFrame:
    """(schema, file, line, source_framework, name, type_annotation, is_optional, is_primary_key, constraints, schema_ord, field_ord)."""
    rows = ir.select("path", F.posexplode("schemas").alias("schema_ord", "s")).select("path", "schema_ord", "s", F.posexplode("s.fields").alias("field_ord", "f"))
    return rows.select(F.col("s.name").alias("schema"), F.col("path").alias("file"), F.col("s.span.start_line").alias("line"), F.col("s.source_framework").alias("source_framework"), "f.*", "schema_ord", "field_ord")


def routes(ir: DataFrame) -> DataFrame:
    """(service, file, method, path, handler, service_ord, route_ord)."""
    rows = ir.select("path", F.posexplode("services").alias("service_ord", "s")).select(F.col("path").alias("file"), "service_ord", F.col("s.name").alias("service"), F.posexplode("s.routes").alias("route_ord", "r"))
    return rows.select("service", "file", "r.method", "r.path", "r.handler", "service_ord", "route_ord")


def imports(ir: DataFrame) -> DataFrame:
    """(file, source, symbols, is_wildcard, import_ord)."""
    return ir.select(F.col("path").alias("file"), F.posexplode("imports").alias("import_ord", "i")).select("file", "i.source", "i.symbols", "i.is_wildcard", "import_ord")


def exports(ir: DataFrame) -> DataFrame:
    """(file, name, kind, source, export_ord)."""
    return ir.select(F.col("path").alias("file"), F.posexplode("exports").alias("export_ord", "e")).select("file", "e.name", "e.kind", "e.source", "export_ord")


def implements(ir: DataFrame) -> DataFrame:
    """(interface_name, implementor, impl_file, edge_kind, ord): of classes first, then of implementations with a trait."""
    classes = ir.select("path", F.posexplode("classes").alias("o", "c")).select(F.explode("c.implements").alias("interface_name"), F.col("c.name").alias("implementor"), F.col("path").alias("impl_file"), F.lit(0).alias("edge_kind"), F.col("o").alias("ord"))
    impls = ir.select("path", F.posexplode("implementations").alias("o", "c")).where("c.trait_name is not null").select(F.col("c.trait_name").alias("interface_name"), F.col("c.target").alias("implementor"), F.col("path").alias("impl_file"), F.lit(1).alias("edge_kind"), F.col("o").alias("ord"))
    return classes.unionByName(impls)


def stats(ir: DataFrame) -> DataFrame:
    """One row of totals. Methods are those of classes, services and implementations; a class that is a service counts twice."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.size(c), F.lit(0))), F.lit(0)).alias
    held = lambda c: F.aggregate(F.coalesce(F.col(c), F.array()), F.lit(0), lambda a, x: a + F.size(x.getField("methods")))
    every = F.coalesce(F.sum(held("classes") + held("services") + held("implementations")), F.lit(0)).alias("total_methods")
    out = [total(c)(f"total_{c}") for c in ("interfaces", "services", "classes", "functions", "schemas", "implementations", "type_aliases")]
    return ir.agg(F.count("*").alias("total_files"), *out, every)


def files_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"))


def children(ir: DataFrame) -> DataFrame:
    """(kind, owner, file, child_kind, child, child_ord): methods then properties of types, methods then routes of services, fields of schemas."""
    labelled = lambda array, kind, name: F.transform(array, lambda x: F.struct(F.lit(kind).alias("child_kind"), x.getField(name).alias("child")))
    parts = []
    for column, kind, lists in (("interfaces", "interface", (("methods", "method", "name"), ("properties", "property", "name"))), ("classes", "class", (("methods", "method", "name"), ("properties", "property", "name"))), ("services", "service", (("methods", "method", "name"), ("routes", "route", "path"))), ("schemas", "schema", (("fields", "field", "name"),))):
        joined = F.concat(*[labelled(F.col(f"e.{c}"), k, n) for c, k, n in lists])
        rows = ir.select("path", F.explode(column).alias("e")).select(F.lit(kind).alias("kind"), F.col("e.name").alias("owner"), F.col("path").alias("file"), F.posexplode(joined).alias("child_ord", "c"))
        parts.append(rows.select("kind", "owner", "file", "c.child_kind", "c.child", "child_ord"))
    return reduce(DataFrame.unionByName, parts)
