"""References between files: imports to files, interfaces to implementors, exports to origins, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths

# Extensions an import may leave out, in order of preference.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "rs", "go", "java", "kt", "scala", "cs", "swift", "cpp", "hpp", "php", "rb")
INDEX_EXTENSIONS = ("ts", "tsx", "js", "jsx")


def path_index(files: DataFrame, root: str = "") -> DataFrame:
    """(key, file): a file by its path, its path from the root with and without extension and ./, and its stem; the last file of a key wins."""
    rel = F.expr(f"substring(file, {len(root) + 2})") if root else F.col("file")
    bare = paths.without_extension(rel)
    keys = F.array(F.col("file"), rel, bare, F.concat(F.lit("./"), rel), F.concat(F.lit("./"), bare), paths.stem(F.col("file")))
    rows = files.select(F.col("path").alias("file")).withColumn("key", F.explode(F.array_distinct(keys)))
    return rows.groupBy("key").agg(F.max("file").alias("file"))


def _candidates():
    exact = lambda x: [x] + [F.concat(x, F.lit(f".{e}")) for e in EXTENSIONS] + [F.concat(x, F.lit(f"/index.{e}")) for e in INDEX_EXTENSIONS]
    return F.when(F.col("at").isNotNull(), F.array("source", *exact(F.col("at")))).otherwise(F.array(*exact(F.col("source"))))


def resolve_imports(imports: DataFrame, index: DataFrame) -> DataFrame:
    """imports (file, source, symbols, is_wildcard, import_ord) with resolved_path, null where no key fits, and names.

    A source is looked up as it stands; else one that starts with ./ or ../ from its file's directory, with and without
    each extension, and any other with each extension and as a directory's index. The first key that exists wins.
    What several imports would look up alike is looked up once. Spark guesses these tables by the bytes of compressed
    files, however many rows each gives, so they are merged and never sent to the driver for a broadcast.
    """
    keyed = imports.withColumn("dir", F.when(F.col("source").rlike(r"^\.\.?/"), paths.parent(F.col("file"))).otherwise(""))
    asked = keyed.select("source", "dir").distinct().withColumn("at", F.when(F.col("source").rlike(r"^\.\.?/"), paths.normalized(F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), "source"))))
    tries = asked.select("source", "dir", F.posexplode(_candidates()).alias("priority", "key"))
    hits = tries.join(index.withColumnRenamed("file", "target").hint("merge"), "key").groupBy("source", "dir").agg(F.min(F.struct("priority", "target")).alias("best"))
    names = F.when(F.col("is_wildcard"), F.array(F.lit("*"))).otherwise(F.transform("symbols", lambda s: F.when(s.getField("alias").isNotNull(), F.concat(s.getField("name"), F.lit(" as "), s.getField("alias"))).otherwise(s.getField("name"))))
    return keyed.join(hits.hint("merge"), ["source", "dir"], "left").select("file", "source", F.col("best.target").alias("resolved_path"), names.alias("symbols"), "is_wildcard", "import_ord")


def resolve_exports(exports: DataFrame, imports_resolved: DataFrame) -> DataFrame:
    """(file, name, origin_file, via_file, export_ord): re-exports point one step on, to the file their source resolves to, or stay."""
    return exports.join(imports_resolved.select("file", F.col("source"), "resolved_path").distinct(), ["file", "source"], "left").select(
        "file", "name", F.when(F.col("kind") == "re_export", F.coalesce("resolved_path", "file")).otherwise(F.col("file")).alias("origin_file"), F.when(F.col("kind") == "re_export", F.col("file")).alias("via_file"), "export_ord"
    )


def export_sources(exports: DataFrame) -> DataFrame:
    """Re-exports in the form of imports, to be resolved like them."""
    rows = exports.where("source is not null").select("file", "source").distinct()
    return rows.select("file", "source", F.array().cast("array<struct<name: string, alias: string, is_default: boolean, is_namespace: boolean>>").alias("symbols"), F.lit(False).alias("is_wildcard"), F.xxhash64("source").alias("import_ord"))


def chains(exports: DataFrame, hops: int) -> DataFrame:
    """Re-exports followed over up to hops files, an extension: (file, name, origin_file, n_hops)."""
    table = exports.select("file", "name", "origin_file").distinct()
    out = table.withColumn("n_hops", F.when(F.col("origin_file") != F.col("file"), 1).otherwise(0))
    step = table.where("origin_file <> file").select(F.col("file").alias("origin_file"), "name", F.col("origin_file").alias("nxt"))
    for _ in range(hops - 1):
        out = out.join(step, ["origin_file", "name"], "left").select("file", "name", F.coalesce("nxt", "origin_file").alias("origin_file"), (F.col("n_hops") + F.col("nxt").isNotNull().cast("int")).alias("n_hops"))
    return out


def files_by_export(exports: DataFrame) -> DataFrame:
    """(name, files): sorted files that export a name, repeated ones kept."""
    return exports.groupBy("name").agg(F.array_sort(F.collect_list("file")).alias("files"))


def interface_files(interfaces: DataFrame) -> DataFrame:
    """(interface_name, interface_file): of several files that define a name the last one."""
    return interfaces.groupBy(F.col("name").alias("interface_name")).agg(F.max("file").alias("interface_file"))


def implementation_links(edges: DataFrame, interfaces: DataFrame, imports_resolved: DataFrame | None = None) -> DataFrame:
    """edges with interface_file: a file that defines the name, else one that an import which names it (or takes all) resolves to."""
    named = interface_files(interfaces)
    out = edges.join(named.hint("merge"), "interface_name", "left")  # guessed too small, as in resolve_imports
    if imports_resolved is None:
        return out
    through = imports_resolved.where("resolved_path is not null").select(F.col("file").alias("impl_file"), "import_ord", "resolved_path", F.explode("symbols").alias("symbol"))
    through = through.withColumn("interface_name", F.regexp_replace(F.col("symbol"), r"^.* as ", "")).groupBy("impl_file", "interface_name").agg(F.min(F.struct("import_ord", "resolved_path")).alias("first"))
    return out.join(through.hint("merge"), ["impl_file", "interface_name"], "left").withColumn("interface_file", F.coalesce("interface_file", "first.resolved_path")).drop("first")


def missing_methods(edges: DataFrame, interface_methods: DataFrame, methods: DataFrame) -> DataFrame:
    """(interface_name, implementor, impl_file, missing): required methods of an interface that its implementor lacks.

    Of several interfaces of a name the last counts. An implementor's methods are those of its first class, or else of its
    first implementation, in the file of the link. Links to unknown interfaces are skipped.
    """
    last = interface_methods.groupBy("interface").agg(F.max(F.struct("file", "iface_ord")).alias("last"))
    required = interface_methods.join(last, "interface").where("file = last.file and iface_ord = last.iface_ord and not has_default").select(F.col("interface").alias("interface_name"), F.col("name").alias("method"))
    owners = methods.where("owner_kind in ('class', 'impl')")
    first = owners.groupBy("owner_name", "file").agg(F.min(F.struct("kind_ord", "owner_ord")).alias("first"))
    held = owners.join(first, ["owner_name", "file"]).where("kind_ord = first.kind_ord and owner_ord = first.owner_ord").select(F.col("owner_name").alias("implementor"), F.col("file").alias("impl_file"), F.col("name").alias("method")).distinct()
    wanted = edges.select("interface_name", "implementor", "impl_file").distinct().join(required.distinct(), "interface_name")
    gaps = wanted.join(held, ["implementor", "impl_file", "method"], "left_anti")
    return gaps.groupBy("interface_name", "implementor", "impl_file").agg(F.array_sort(F.collect_set("method")).alias("missing"))


def unimplemented(interfaces: DataFrame, edges: DataFrame) -> DataFrame:
    """Public interfaces whose exact name nothing implements."""
    return interfaces.where("visibility = 'public'").join(edges.select(F.col("interface_name").alias("name")).distinct(), "name", "left_anti")


def duplicates_after_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn > 1").drop("rn")
