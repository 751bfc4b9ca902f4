"""Deeply nested records to flat tables that keep parent-child links.

The projection is made of higher-order SQL functions alone: nested transform calls attach the parent's key and the
place in its array, flatten joins the arrays of one level, and one inline per target table emits the rows. A recursive
field has no finite type, so a body is parsed once, to a variant, and each element of an array is cast by itself: the
children below the deepest level of a projection stay variants, which the next projection takes up with their parent's
key, until none is left; any depth comes out whole.

Defined cases. A body that is null or not JSON gives no rows, and so does one with an object that has a key twice.
Missing, null and empty arrays and maps, null elements and elements of another type give no rows; the other elements of
the same array keep their rows and places. A field of another type is null where it cannot be cast. A null key gives rows
with a null key. Records delivered again give the same rows, which count once. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import cut

#: Levels of a recursive field that one projection unrolls.
LEVELS = 4
#: Scalar and list fields of a subsystem, in the order of the flat table, with their JSON names.
SUBSYSTEM_FIELDS = {
    "name": ("name", "string"),
    "domain": ("domain", "string"),
    "status": ("status", "string"),
    "file_path": ("filePath", "string"),
    "interfaces": ("interfaces", "array<string>"),
    "operations": ("operations", "array<string>"),
    "tables": ("tables", "array<string>"),
    "events": ("events", "array<string>"),
    "dependencies": ("dependencies", "array<string>"),
}


def _node_type(fields: dict[str, tuple[str, str]]) -> str:
    own = "".join(f"`{name}`: {kind}, " for name, kind in fields.values())
    return f"struct<id: string, {own}children: array<variant>>"


def _nodes(array: Column, node: str) -> Column:
    """The objects of an array of variants with their places, each cast by itself."""
    placed = F.transform(array, lambda v, i: F.struct(F.try_variant_get(v, "$", node).alias("c"), i.alias("j")))
    return F.filter(placed, lambda x: x.getField("c").isNotNull())


def _row(parent: Column, pos: Column, node: Column, depth: Column, rest: Column, fields: dict[str, tuple[str, str]]) -> Column:
    own = [node.getField(name).alias(column) for column, (name, _) in fields.items()]
    return F.struct(parent.alias("parent_key"), pos.cast("long").alias("pos"), node.getField("id").alias("child_key"), depth.alias("depth"), *own, rest.alias("rest"))


def _unroll(array: Column, parent: Column, depth: Column, levels: int, fields: dict[str, tuple[str, str]]) -> Column:
    """One array of all rows of the first levels below an array of variants."""
    node = _node_type(fields)

    def below(x: Column, parent: Column, at: int) -> Column:
        own, last = x.getField("c"), at == levels - 1
        rest = own.getField("children") if last else F.lit(None).cast("array<variant>")
        row = F.array(_row(parent, x.getField("j"), own, depth + at, rest, fields))
        if last:
            return row
        lower = F.flatten(F.transform(_nodes(own.getField("children"), node), lambda y: below(y, own.getField("id"), at + 1)))
        return F.concat(row, F.coalesce(lower, F.array().cast(_rows_type(fields))))

    return F.flatten(F.transform(_nodes(array, node), lambda x: below(x, parent, 0)))


def _rows_type(fields: dict[str, tuple[str, str]]) -> str:
    own = "".join(f"`{column}`: {kind}, " for column, (_, kind) in fields.items())
    return f"array<struct<parent_key: string, pos: bigint, child_key: string, depth: int, {own}rest: array<variant>>>"


def flatten_subsystems(manifests: DataFrame, record: str = "record_id", body: str = "body", fields: dict[str, tuple[str, str]] | None = None, levels: int = LEVELS) -> DataFrame:
    """(record_id, parent_key, pos, child_key, depth, fields...): each distinct subsystem row at any depth of a manifest's tree.

    parent_key is '' at the top. fields: column -> (JSON name, type) to carry along; all by default.
    """
    fields = SUBSYSTEM_FIELDS if fields is None else fields
    top = F.try_variant_get(F.try_parse_json(F.col(body)), "$.subsystems", "array<variant>")
    whole = manifests.select(F.col(record).alias("record_id"), top.alias("n"))
    rows = cut(whole.select("record_id", F.inline(_unroll(F.col("n"), F.lit(""), F.lit(0), levels, fields))))
    flat = ["record_id", "parent_key", "pos", "child_key", "depth", *fields]
    out = rows.select(flat)
    while True:
        rest = rows.where(F.size("rest") > 0).select("record_id", F.col("child_key").alias("up"), (F.col("depth") + 1).alias("at"), F.col("rest").alias("n"))
        if rest.isEmpty():
            return out.distinct()
        rows = cut(rest.select("record_id", F.inline(_unroll(F.col("n"), F.col("up"), F.col("at"), levels, fields))))
        out = out.unionByName(rows.select(flat))


def flatten_links(results: DataFrame, record: str = "record_id", links: str = "impl_links") -> DataFrame:
    """(record_id, parent_key '', pos, interface_name, child_key, impl_file, interface_file): each distinct implementation link."""
    placed = F.transform(
        F.col(links),
        lambda x, i: F.struct(
            F.lit("").alias("parent_key"), i.cast("long").alias("pos"), x.isNotNull().alias("there"), x.getField("interface_name").alias("interface_name"),
            x.getField("implementor").alias("child_key"), x.getField("impl_file").alias("impl_file"), x.getField("interface_file").alias("interface_file"),
        ),
    )
    return results.select(F.col(record).alias("record_id"), F.inline(F.filter(placed, lambda x: x.getField("there")))).drop("there").distinct()


def flatten_exports(results: DataFrame, record: str = "record_id", exports: str = "exports_by_file") -> DataFrame:
    """(record_id, parent_key, pos, child_key, origin_file, via_file): each distinct export of a file, parent_key being the file."""

    def per_file(entry: Column) -> Column:
        placed = F.transform(
            entry.getField("value"),
            lambda x, i: F.struct(
                entry.getField("key").alias("parent_key"), i.cast("long").alias("pos"), x.isNotNull().alias("there"), x.getField("name").alias("child_key"),
                x.getField("origin_file").alias("origin_file"), x.getField("via_file").alias("via_file"),
            ),
        )
        return F.filter(placed, lambda x: x.getField("there"))

    entries = F.filter(F.map_entries(F.col(exports)), lambda e: e.getField("value").isNotNull())
    return results.select(F.col(record).alias("record_id"), F.inline(F.flatten(F.transform(entries, per_file)))).drop("there").distinct()


def flat_rows(manifests: DataFrame, results: DataFrame) -> DataFrame:
    """(record_id, section, parent_key, pos, child_key) of the three flat tables together."""
    parts = {
        "subsystems": flatten_subsystems(manifests, fields={}),
        "impl_links": flatten_links(results),
        "exports_by_file": flatten_exports(results),
    }
    shaped = [df.select("record_id", F.lit(section).alias("section"), "parent_key", "pos", "child_key") for section, df in parts.items()]
    return shaped[0].unionByName(shaped[1]).unionByName(shaped[2]).distinct()
