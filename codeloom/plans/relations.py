"""Queries of files, entities, manifests, graphs, stores and outputs over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.extract import scanner
from codeloom.functions import names, paths
from codeloom.operators import bootstrap, cache, graph, manifest, query, sinks, tables, validate, work
from codeloom.runtime import read, stored
from codeloom.sources import files as sources

BUDGET = 400_000


def _files(spark: SparkSession, root: str) -> DataFrame:
    return sources.in_repositories(read(spark, root, "walked_files").select("file_id", "repo", "path", "language", "content", "mtime", "size"))


def _entities(spark: SparkSession, root: str) -> DataFrame:
    rows = read(spark, root, "entity_summaries").select("entity_id", "manifest_id", F.concat_ws("/", "repo", F.regexp_replace("file", r"^\./", "")).alias("file"), "name", "kind", "line", "language", "build_status", "confidence", "subsystem_id")
    order = F.create_map(*[F.lit(x) for i, (k, _, _) in enumerate(tables.KINDS.values()) for x in (k, i)])
    return rows.distinct().withColumn("visibility", F.lit(None).cast("string")).withColumn("kind_ord", order[F.col("kind")]).withColumn("ent_ord", F.col("entity_id"))


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    """Distinct rows of entity_summaries without the subsystem stored with them; file is relative to the repository, as the paths in manifests are."""
    rows = read(spark, root, "entity_summaries").select("entity_id", "manifest_id", "repo", F.regexp_replace("file", r"^\./", "").alias("file"), "name", "kind", "line", "language", "build_status", "confidence", "subsystem_id")
    return rows.distinct().drop("subsystem_id")


def _subsystems(spark: SparkSession, root: str) -> DataFrame:
    """One row per subsystem: of several rows of an id the one registered last."""
    last = Window.partitionBy("manifest_id", "id").orderBy(F.desc("registered_at"), F.desc("dfs_ord"))
    return read(spark, root, "subsystems").withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def _placed(spark: SparkSession, root: str) -> DataFrame:
    """Subsystems with those of no known domain in the synthetic one."""
    return graph.normalize_orphans(_subsystems(spark, root), read(spark, root, "subsystem_domains"))


def _connections(spark: SparkSession, root: str) -> DataFrame:
    subs = _subsystems(spark, root)
    return subs.select("manifest_id", F.col("id").alias("from"), F.explode("dependencies").alias("to")).where("to <> ''").distinct()


def file_inventory_by_language(spark, root):
    rows = read(spark, root, "walked_files").withColumn("language", paths.language(F.col("path")))
    return rows.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def language_of_path(spark, root):
    return read(spark, root, "walked_files").select("file_id", paths.language(F.col("path")).alias("language"), paths.extension(F.col("path")).alias("ext"))


def path_parts(spark, root):
    p = F.col("path")
    return read(spark, root, "walked_files").select("file_id", paths.parent(p).alias("parent"), paths.stem(p).alias("stem"), paths.without_extension(p).alias("bare"), paths.depth(p).alias("depth"))


def path_prefix_component(spark, root):
    return read(spark, root, "walked_files").where(paths.has_prefix(F.col("path"), F.lit("services/"))).select("file_id", "path")


def path_normalized(spark, root):
    return read(spark, root, "entity_summaries").select("file").distinct().select("file", paths.normalized(F.concat(F.lit("a/../"), F.col("file"))).alias("normalized"))


def path_ancestors(spark, root):
    return read(spark, root, "walked_files").select(F.explode(paths.ancestors(F.col("path"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def glob_filter(spark, root):
    rows = read(spark, root, "walked_files").where(paths.included(F.col("path"), ["**/*.ts", "**/*.rs"], ["**/tests/**"]))
    return rows.select("file_id", "path")


def content_hash_dups(spark, root):
    rows = read(spark, root, "walked_files").select("file_id", F.sha2("content", 256).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("file_id").alias("first_id")).where("n > 1")


def source_slices(spark, root):
    """The source of each scanned entity."""
    files = _files(spark, root)
    ir = stored(scanner.ir_files(files.select("path", "language", "content", F.sha2("content", 256).alias("content_hash"))))
    spans = [ir.select("path", F.lit(kind).alias("kind"), F.explode(c).alias("e")).select("path", "kind", "e.span.byte_range.start", "e.span.byte_range.end") for c, (kind, _, _) in tables.KINDS.items()]
    return sources.slice_source(files, reduce(DataFrame.unionByName, spans)).select("path", "kind", "start", "end", F.sha2("source", 256).alias("digest"))


def build_status_of_tree(spark, root):
    files = _files(spark, root)
    return sources.build_status(files.select("path", "mtime", "content"), "TypeScript")


def cache_hit_miss(spark, root):
    """Against a store of the files that entity_summaries names as scanned."""
    files = _files(spark, root).withColumn("content_hash", F.sha2("content", 256))
    scanned = _entities(spark, root).select(F.col("file").alias("path")).distinct()
    hits, misses = cache.split(files, files.join(scanned, "path", "left_semi"))
    return hits.agg(F.count("*").alias("hits")).join(misses.agg(F.count("*").alias("misses")))


def cache_lru_evict(spark, root):
    store = _files(spark, root).select("path", F.col("mtime").alias("last_accessed"), "size")
    return cache.evict(store, BUDGET).select("path", "size")


def cache_prune(spark, root):
    files = _files(spark, root)
    _, dropped = cache.prune(_entities(spark, root).select(F.col("file").alias("path")).distinct(), files.where("language <> 'Java'"))
    return dropped.select("path")


def cache_stats(spark, root):
    return cache.stats(_files(spark, root), "size", BUDGET)


def entity_kinds(spark, root):
    return _entities(spark, root).groupBy("language", "kind").agg(F.count("*").alias("n"))


def entity_filter_multi(spark, root):
    wanted = query.Filters(languages=["TypeScript", "Java"], name="Broker", kinds=["class", "service"], build_status="built", path_prefix="quayside")
    return query.summaries(_entities(spark, root), wanted).select("entity_id", "name", "kind", "file")


def entity_search(spark, root):
    return query.search(_entities(spark, root), "Ledger", "class,interface,nonsense").select("entity_id", "name", "kind")


def entity_detail_last_wins(spark, root):
    return query.detail(_entities(spark, root)).select("name", "file", "kind", "entity_id")


def naming_of_entities(spark, root):
    rows = _entities(spark, root)
    return rows.select("entity_id", names.is_pascal(F.col("name")).alias("pascal"), names.follows_convention(F.col("name"), F.col("language")).alias("fits"), names.convention(F.col("language")).alias("convention"))


def humanized_ids(spark, root):
    return read(spark, root, "subsystems").select("id").distinct().select("id", names.humanized(F.col("id")).alias("label"))


def export_csv_lines(spark, root):
    return sinks.csv_lines(_entities(spark, root))


def export_markdown_lines(spark, root):
    return sinks.markdown_lines(_entities(spark, root))


def export_json_lines(spark, root):
    return sinks.json_lines(_entities(spark, root).select("name", "kind", "file"))


def language_stats(spark, root):
    return tables.files_by_language(read(spark, root, "walked_files"))


def _manifest_entities(spark, root):
    """Entities of each manifest: the interfaces and tables its subsystems list, under the subsystem's path or elsewhere."""
    subs = _subsystems(spark, root)
    one = lambda c, k: subs.select("manifest_id", F.posexplode(c).alias("p", "name"), F.lit(k).alias("kind"), "file_path", "dfs_ord")
    rows = one("interfaces", "interface").unionByName(one("tables", "schema")).where("name is not null")
    at = F.when((F.col("dfs_ord") + F.col("p")) % 3 == 0, F.concat(F.lit("elsewhere/"), F.col("name"))).otherwise(F.concat_ws("/", F.regexp_replace(F.coalesce("file_path", F.lit("none")), "/+$", ""), "name"))
    return rows.select("manifest_id", "name", "kind", at.alias("file")).distinct()


def manifest_match_listed(spark, root):
    """Entities made from the lists of the subsystems they are matched to, which all match."""
    return manifest.match(_manifest_entities(spark, root), _subsystems(spark, root)).select("manifest_id", "name", "kind", "file", "subsystem_id", "match_strategy")


def manifest_coverage_listed(spark, root):
    return manifest.coverage(manifest.match(_manifest_entities(spark, root), _subsystems(spark, root)))


def _id():
    """manifest_id as text, '' for none."""
    return F.coalesce(F.col("manifest_id").cast("string"), F.lit("")).alias("manifest_id")


def manifest_match(spark, root):
    """The scanned entities with their subsystems; one without a manifest is unmatched."""
    matched = manifest.match(_scanned(spark, root), _subsystems(spark, root))
    return matched.select("entity_id", _id(), "repo", "file", "name", "kind", "subsystem_id", "match_strategy")


def manifest_coverage(spark, root):
    return manifest.coverage(manifest_match(spark, root))


def manifest_candidates(spark, root):
    """Candidates for the entities that match leaves without a subsystem; one without a manifest is held against all manifests of its repository."""
    rows = _scanned(spark, root)
    left = manifest.match(rows, _subsystems(spark, root)).where("subsystem_id is null").select("manifest_id", "repo", "name").distinct()
    of_repo = rows.where("manifest_id is not null").select("repo", "manifest_id").distinct()
    lost = left.where("manifest_id is null").drop("manifest_id").join(of_repo, "repo")
    ents = left.where("manifest_id is not null").select("manifest_id", "name").unionByName(lost.select("manifest_id", "name"))
    return manifest.candidates(ents, _subsystems(spark, root)).select("manifest_id", "name", F.array_join("candidates", ",").alias("candidates"))


def manifest_rollup(spark, root):
    return manifest.rollup(_subsystems(spark, root), _entities(spark, root))


def manifest_names(spark, root):
    return validate.manifest_names(_subsystems(spark, root))


def manifest_references(spark, root):
    return validate.manifest_references(_subsystems(spark, root), read(spark, root, "subsystem_domains"))


def manifest_writeback(spark, root):
    out = manifest.write_back(_subsystems(spark, root), _entities(spark, root))
    return out.select("manifest_id", "id", F.array_join(F.array_sort("interfaces"), ",").alias("interfaces"), F.array_join(F.array_sort("operations"), ",").alias("operations"), F.array_join(F.array_sort("tables"), ",").alias("tables"))


def subsystem_filter(spark, root):
    return query.subsystem_filter(_subsystems(spark, root), None, "built", "LEDGER").select("manifest_id", "id")


def domain_siblings(spark, root):
    return manifest.domain_children(_subsystems(spark, root))


def bootstrap_dir_groups(spark, root):
    return bootstrap.directory_groups(read(spark, root, "walked_files")).groupBy("domain", "subsystem").agg(F.count("*").alias("n"))


def bootstrap_common_prefix(spark, root):
    return bootstrap.common_prefix(bootstrap.directory_groups(read(spark, root, "walked_files")), ["repo"])


def bootstrap_subsystems(spark, root):
    return bootstrap.subsystems(read(spark, root, "walked_files"), 3)


def bootstrap_edges_capped(spark, root):
    """Connections between domains over all manifests, counted and capped."""
    edges = graph.domain_edges(_connections(spark, root), _placed(spark, root))
    return bootstrap.capped(edges.groupBy(F.col("after").alias("from"), F.col("before").alias("to")).agg(F.sum("weight").alias("weight")))


def unique_ids(spark, root):
    rows = read(spark, root, "part").select("p_partkey", F.lower("p_brand").alias("base"))
    return bootstrap.unique_ids(rows, "base", ["p_partkey"]).select("p_partkey", "id")


def palette_cycle(spark, root):
    return graph.palette_colors(_placed(spark, root))


def _starts(spark, root):
    return _subsystems(spark, root).where("dfs_ord = 0").select("manifest_id", "id")


def graph_closure_nodes(spark, root):
    return graph.closure(_connections(spark, root), _starts(spark, root))[0]


def graph_closure_edges(spark, root):
    return graph.closure(_connections(spark, root), _starts(spark, root), upstream=False)[1]


def orphan_domains(spark, root):
    return graph.normalize_orphans(_subsystems(spark, root), read(spark, root, "subsystem_domains")).select("manifest_id", "id", "domain")


def domain_layers(spark, root):
    subs = graph.normalize_orphans(_subsystems(spark, root), read(spark, root, "subsystem_domains"))
    return graph.domain_layers(subs, _connections(spark, root))


def domain_grid(spark, root):
    return graph.grid(domain_layers(spark, root).drop("cut"))


def edge_bundles(spark, root):
    return graph.bundles(_connections(spark, root), _subsystems(spark, root))


def station_fan_out(spark, root):
    return graph.fan_out(_subsystems(spark, root), _connections(spark, root))


def station_positions(spark, root):
    subs = _placed(spark, root)
    order = graph.station_order(graph.station_depths(subs, _connections(spark, root)), graph.fan_out(subs, _connections(spark, root)))
    x, y = graph.line_offset(F.col("position"))
    return order.select("manifest_id", "domain", "id", "topo_depth", "position", x.alias("x"), y.alias("y"))


def line_positions(spark, root):
    line = Window.partitionBy("manifest_id", "domain").orderBy("id")
    rows = _placed(spark, root).select("manifest_id", "id", (F.row_number().over(line) - 1).alias("position"))
    x, y = graph.line_offset(F.col("position"))
    return rows.select("manifest_id", "id", x.alias("x"), y.alias("y"))


def compact_positions(spark, root):
    """The stations of subsystems that are built, put close together."""
    subs = _placed(spark, root)
    line = Window.partitionBy("manifest_id", "domain").orderBy("id")
    order = subs.select("manifest_id", "domain", "id", (F.row_number().over(line) - 1).alias("position"))
    return graph.compact_layout(order, subs.where("status = 'built'"))


def subsystem_entities(spark, root):
    """Entities of each subsystem and of its direct children, from what the scanner matched."""
    return query.subsystem_entities(_entities(spark, root), _subsystems(spark, root), nested=True).groupBy("manifest_id", "id").agg(F.count("*").alias("n_entities"), F.countDistinct("file").alias("n_files"))


def subsystem_by_id(spark, root):
    """The subsystems that share the most frequent id, the first by name."""
    subs = _subsystems(spark, root)
    most = subs.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1)
    return subs.join(F.broadcast(most), "id").select("manifest_id", "id", "name", "n")


def manifest_report(spark, root):
    return validate.manifest_report(manifest_names(spark, root), manifest_references(spark, root))


def coverage_classes(spark, root):
    per = manifest_match(spark, root).groupBy("manifest_id").agg((F.count("subsystem_id") * 100.0 / F.count("*")).alias("p"))
    percent, kind = query.coverage_class(F.col("p"))
    return per.select("manifest_id", F.round(percent, 6).alias("percent"), kind.alias("class"))


def table_export(spark, root):
    """Domains as a text table."""
    return sinks.table_lines(read(spark, root, "subsystem_domains").select("domain_id", "label"))


def cache_get_remove(spark, root):
    """A store of all files of which the scanned ones are used again and those of equal content as an earlier file are removed."""
    store = _files(spark, root).select("path", F.sha2("content", 256).alias("content_hash"), F.col("mtime").alias("last_accessed"))
    scanned = _entities(spark, root).select(F.col("file").alias("path")).distinct()
    hit, touched = cache.get(store, store.join(scanned, "path", "left_semi"), F.lit("2030-01-01").cast("timestamp"))
    again = store.groupBy("content_hash").count().where("count > 1")
    kept = cache.remove(touched, again)
    return kept.agg(F.count("*").alias("kept"), F.count_if(F.col("last_accessed") == F.lit("2030-01-01").cast("timestamp")).alias("touched"))


def visible_edges(spark, root):
    seen = _subsystems(spark, root).where("status = 'built'").select("manifest_id", "id")
    one = lambda c: F.concat_ws("/", F.col("manifest_id").cast("string"), c)
    edges = _connections(spark, root).select(one("from").alias("source"), one("to").alias("target"))
    return query.visible_edges(edges, seen.select(one("id").alias("id")))


def visible_lines(spark, root):
    return graph.visible_lines(_placed(spark, root))


def partition_slices(spark, root):
    return work.slices(_files(spark, root), 5)


def partition_round_robin(spark, root):
    return work.round_robin(_files(spark, root), 5)


def dirs_collect(spark, root):
    return work.directories(read(spark, root, "walked_files"), ["repo"])


QUERIES = {
    f.__name__: f
    for f in (
        file_inventory_by_language, language_of_path, path_parts, path_prefix_component, path_normalized, path_ancestors, glob_filter, content_hash_dups, source_slices, build_status_of_tree, cache_hit_miss, cache_get_remove,
        cache_lru_evict, cache_prune, cache_stats, entity_kinds, entity_filter_multi, entity_search, entity_detail_last_wins, naming_of_entities, humanized_ids, export_csv_lines, export_markdown_lines, table_export,
        export_json_lines, language_stats, manifest_match, manifest_coverage, manifest_match_listed, manifest_coverage_listed, manifest_candidates, manifest_report, coverage_classes, subsystem_entities, subsystem_by_id, manifest_rollup, manifest_names, manifest_references, manifest_writeback, subsystem_filter, domain_siblings,
        bootstrap_dir_groups, bootstrap_common_prefix, bootstrap_subsystems, bootstrap_edges_capped, unique_ids, palette_cycle, graph_closure_nodes, graph_closure_edges, orphan_domains, domain_layers,
        domain_grid, edge_bundles, station_fan_out, station_positions, line_positions, compact_positions, visible_edges, visible_lines, partition_slices, partition_round_robin, dirs_collect,
    )
}

_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]+)$', 1)"
_LANG = f"CASE {_EXT} " + " ".join(f"WHEN '{e}' THEN '{k}'" for k, v in paths.EXTENSIONS.items() for e in v) + " END"
_FULL = "repo || '/' || path"
_ENT = """WITH e AS (SELECT DISTINCT entity_id, manifest_id, repo || '/' || regexp_replace(file, '^\\./', '') AS file, name, kind, line, language, build_status, confidence, subsystem_id FROM entity_summaries) """
_SUB = """sub AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY manifest_id, id ORDER BY registered_at DESC NULLS LAST, dfs_ord DESC NULLS LAST) AS rn FROM subsystems) WHERE rn = 1)"""
_CON = _SUB + """, con AS (SELECT DISTINCT manifest_id, "from", "to" FROM (SELECT manifest_id, id AS "from", unnest(dependencies) AS "to" FROM sub) WHERE "to" <> '')"""
_MENT = _SUB + """, me AS (SELECT DISTINCT manifest_id, name, kind, CASE WHEN (dfs_ord + p) % 3 = 0 THEN 'elsewhere/' || name ELSE regexp_replace(coalesce(file_path, 'none'), '/+$', '') || '/' || name END AS file FROM (
  SELECT manifest_id, unnest(interfaces) AS name, unnest(range(len(interfaces))) AS p, 'interface' AS kind, file_path, dfs_ord FROM sub UNION ALL
  SELECT manifest_id, unnest(tables), unnest(range(len(tables))), 'schema', file_path, dfs_ord FROM sub) WHERE name IS NOT NULL),
tgt AS (SELECT manifest_id, id, dfs_ord, regexp_replace(file_path, '(.)/+$', '\\1') AS place FROM sub WHERE coalesce(file_path, '') <> ''),
pm AS (SELECT manifest_id, file, id FROM (SELECT me.manifest_id, me.file, tgt.id, row_number() OVER (PARTITION BY me.manifest_id, me.file ORDER BY len(string_split(tgt.place, '/')) DESC, tgt.dfs_ord, tgt.id) AS rn
  FROM (SELECT DISTINCT manifest_id, file FROM me) me JOIN tgt ON tgt.manifest_id = me.manifest_id AND (me.file = tgt.place OR starts_with(me.file, tgt.place || '/'))) WHERE rn = 1),
lists AS (SELECT manifest_id, id, dfs_ord, unnest(interfaces) AS n, NULL AS only FROM sub UNION ALL SELECT manifest_id, id, dfs_ord, unnest(operations), NULL FROM sub
  UNION ALL SELECT manifest_id, id, dfs_ord, regexp_replace(unnest(operations), '\\(\\)$', ''), NULL FROM sub UNION ALL SELECT manifest_id, id, dfs_ord, unnest(events), NULL FROM sub UNION ALL SELECT manifest_id, id, dfs_ord, unnest(tables), 'schema' FROM sub),
nm AS (SELECT manifest_id, name, kind, id FROM (SELECT me.manifest_id, me.name, me.kind, lists.id, row_number() OVER (PARTITION BY me.manifest_id, me.name, me.kind ORDER BY lists.dfs_ord, lists.id) AS rn
  FROM (SELECT DISTINCT manifest_id, name, kind FROM me) me JOIN lists ON lists.manifest_id = me.manifest_id AND lists.n = me.name AND (lists.only IS NULL OR lists.only = me.kind)) WHERE rn = 1),
mm AS (SELECT me.*, coalesce(pm.id, nm.id) AS subsystem_id, CASE WHEN pm.id IS NOT NULL THEN 'file_path' WHEN nm.id IS NOT NULL THEN 'name_match' END AS match_strategy
  FROM me LEFT JOIN pm ON pm.manifest_id = me.manifest_id AND pm.file = me.file LEFT JOIN nm ON nm.manifest_id = me.manifest_id AND nm.name = me.name AND nm.kind = me.kind)"""
_SMENT = _MENT[: _MENT.index(", me AS (")] + """, me AS (SELECT entity_id, manifest_id, repo, file, name, kind FROM (SELECT DISTINCT entity_id, manifest_id, repo, regexp_replace(file, '^\\./', '') AS file, name, kind, line, language, build_status, confidence, subsystem_id FROM entity_summaries)),
""" + _MENT[_MENT.index("tgt AS ("):]
_NORM = _SUB + """, od AS (SELECT s.manifest_id, s.id, CASE WHEN s.domain <> '' AND EXISTS (SELECT 1 FROM subsystem_domains d WHERE d.manifest_id = s.manifest_id AND d.domain_id = s.domain) THEN s.domain ELSE '__unassigned__' END AS domain FROM sub s)"""
_WORD = "upper(left({0}, 1)) || substr({0}, 2)"
_CAMEL = "array_to_string(list_transform(string_split(kind, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), '')"
_FITS = "CASE WHEN language IN ('Rust', 'Go', 'Python', 'Ruby', 'PHP') THEN starts_with(name, '__') OR starts_with(name, 'test_') OR regexp_matches(name, '^[a-z_][a-z0-9_]*$') ELSE name = 'constructor' OR regexp_matches(name, '^[$#]') OR regexp_matches(name, '^[a-z][A-Za-z0-9]*$') END"
_GROUPS = """g AS (SELECT *, len(c) AS n, c[1] AS c0, c[2] AS c1, c[3] AS c2, c[4] AS c3 FROM (SELECT *, string_split(path, '/') AS c FROM walked_files)),
k AS (SELECT *, CASE WHEN n <= 1 THEN '_root' WHEN n = 2 THEN c0 WHEN c0 IN ('crates','packages','apps','modules','services','libs','workspaces','src','lib','app') THEN c1 ELSE c0 END AS domain,
 CASE WHEN n <= 1 THEN c0 WHEN n = 2 THEN c0 WHEN c0 IN ('crates','packages','apps','modules','services','libs','workspaces','src','lib','app') THEN CASE WHEN n > 3 THEN CASE WHEN c2 IN ('src','lib','app') THEN CASE WHEN n > 4 THEN c3 ELSE c1 END ELSE c2 END ELSE c1 END ELSE c1 END AS subsystem FROM g)"""
_TOP = f"CASE WHEN contains({_FULL}, '/') THEN split_part({_FULL}, '/', 1) ELSE '.' END"
_XY = "CAST(CASE WHEN (position // 10) % 2 = 0 THEN position % 10 ELSE 9 - position % 10 END * 420 AS INTEGER) AS x, CAST(position // 10 * 320 AS INTEGER) AS y"
_PAL = "[" + ", ".join(f"'{c}'" for c in graph.PALETTE) + "]"

SQL = {
    "file_inventory_by_language": f"SELECT {_LANG} AS language, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM walked_files GROUP BY 1",
    "language_of_path": f"SELECT file_id, {_LANG} AS language, {_EXT} AS ext FROM walked_files",
    "path_parts": "SELECT file_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]+$', '\\1') AS stem, regexp_replace(path, '([^/])\\.[^./]+$', '\\1') AS bare, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM walked_files",
    "path_prefix_component": "SELECT file_id, path FROM walked_files WHERE path = 'services' OR starts_with(path, 'services/')",
    "path_normalized": "SELECT DISTINCT file, regexp_replace(file, '^\\./', '') AS normalized FROM entity_summaries",
    "path_ancestors": "SELECT prefix, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS prefix FROM walked_files) GROUP BY 1",
    "glob_filter": "SELECT file_id, path FROM walked_files WHERE (path LIKE '%.ts' OR path LIKE '%.rs') AND NOT (path LIKE 'tests/%' OR path LIKE '%/tests/%')",
    "content_hash_dups": "SELECT sha256(content) AS content_hash, count(*) AS n, min(file_id) AS first_id FROM walked_files GROUP BY 1 HAVING count(*) > 1",
    "cache_hit_miss": _ENT + f"SELECT count(*) FILTER (p IN (SELECT file FROM e)) AS hits, count(*) FILTER (p NOT IN (SELECT file FROM e)) AS misses FROM (SELECT {_FULL} AS p FROM walked_files)",
    "cache_get_remove": _ENT + f"SELECT count(*) AS kept, count(*) FILTER (p IN (SELECT file FROM e)) AS touched FROM (SELECT {_FULL} AS p, count(*) OVER (PARTITION BY sha256(content)) AS n FROM walked_files) WHERE n = 1",
    "cache_lru_evict": f"SELECT path, size FROM (SELECT {_FULL} AS path, size, sum(coalesce(size, 0)) OVER (ORDER BY mtime DESC NULLS LAST, {_FULL}) AS run FROM walked_files) WHERE run <= {BUDGET}",
    "cache_prune": _ENT + f"SELECT DISTINCT file AS path FROM e WHERE file NOT IN (SELECT {_FULL} FROM walked_files WHERE language <> 'Java')",
    "cache_stats": f"SELECT count(*) AS entries, CAST(sum(size) AS BIGINT) AS disk_size_bytes, CAST({BUDGET} AS BIGINT) AS max_size_bytes FROM walked_files",
    "entity_kinds": _ENT + "SELECT language, kind, count(*) AS n FROM e GROUP BY ALL",
    "entity_filter_multi": _ENT + "SELECT entity_id, name, kind, file FROM e WHERE language IN ('TypeScript', 'Java') AND contains(name, 'Broker') AND kind IN ('class', 'service') AND build_status = 'built' AND (file = 'quayside' OR starts_with(file, 'quayside/'))",
    "entity_search": _ENT + "SELECT entity_id, name, kind FROM e WHERE contains(name, 'Ledger') AND kind IN ('class', 'interface')",
    "entity_detail_last_wins": _ENT + "SELECT name, file, kind, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, (k, _, _) in enumerate(tables.KINDS.values())) + " END DESC, entity_id DESC) AS rn FROM e) WHERE rn = 1",
    "naming_of_entities": _ENT + f"SELECT entity_id, regexp_matches(name, '^[A-Z][A-Za-z0-9]*$') AS pascal, {_FITS} AS fits, CASE WHEN language IN ('Rust', 'Go', 'Python', 'Ruby', 'PHP') THEN 'snake_case' ELSE 'camelCase' END AS convention FROM e",
    "humanized_ids": "SELECT DISTINCT id, array_to_string(list_transform(list_filter(regexp_split_to_array(id, '[-_]'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label FROM subsystems",
    "export_csv_lines": _ENT + f"""SELECT '"' || replace(name, '"', '""') || '",' || {_CAMEL} || ',"' || replace(file, '"', '""') || '",' || coalesce(CAST(line AS VARCHAR), '') || ',' || language || ',' || {_WORD.format('build_status')} AS line FROM e""",
    "export_markdown_lines": _ENT + "SELECT '| ' || name || ' | ' || kind || ' | ' || file || ' | ' || coalesce(CAST(line AS VARCHAR), '') || ' | ' || language || ' | ' || build_status || ' |' AS line FROM e",
    "table_export": "SELECT rtrim(rpad(domain_id, w, ' ') || '  ' || label) AS value FROM (SELECT domain_id, coalesce(label, '') AS label, CAST(max(greatest(len(domain_id), 9)) OVER () AS INTEGER) AS w FROM subsystem_domains)",
    "export_json_lines": _ENT + """SELECT '{"file":"' || file || '","kind":"' || kind || '","name":"' || name || '"}' AS value FROM e""",
    "language_stats": "SELECT language, count(*) AS n_files FROM walked_files GROUP BY 1",
    "manifest_match_listed": "WITH " + _MENT + " SELECT manifest_id, name, kind, file, subsystem_id, match_strategy FROM mm",
    "manifest_coverage_listed": "WITH " + _MENT + " SELECT count(*) AS total_entities, count(subsystem_id) AS n_matched, CASE WHEN count(*) = 0 THEN 100.0 ELSE count(subsystem_id) * 100.0 / count(*) END::DOUBLE AS coverage_percent FROM mm",
    "manifest_match": "WITH " + _SMENT + " SELECT entity_id, coalesce(CAST(manifest_id AS VARCHAR), '') AS manifest_id, repo, file, name, kind, subsystem_id, match_strategy FROM mm",
    "manifest_coverage": "WITH " + _SMENT + " SELECT count(*) AS total_entities, count(subsystem_id) AS n_matched, CASE WHEN count(*) = 0 THEN 100.0 ELSE count(subsystem_id) * 100.0 / count(*) END::DOUBLE AS coverage_percent FROM mm",
    "coverage_classes": "WITH " + _SMENT + ", p AS (SELECT coalesce(CAST(manifest_id AS VARCHAR), '') AS manifest_id, count(subsystem_id) * 100.0 / count(*) AS p FROM mm GROUP BY 1) SELECT manifest_id, round(CAST(p AS DOUBLE), 6) AS percent, CASE WHEN p >= 80 THEN 'high' WHEN p >= 50 THEN 'medium' ELSE 'low' END AS class FROM p",
    "manifest_candidates": "WITH " + _SMENT + """, l AS (SELECT DISTINCT manifest_id, repo, name FROM mm WHERE subsystem_id IS NULL AND name <> ''),
u AS (SELECT manifest_id, name FROM l WHERE manifest_id IS NOT NULL UNION SELECT m.manifest_id, l.name FROM l JOIN (SELECT DISTINCT repo, manifest_id FROM me WHERE manifest_id IS NOT NULL) m ON m.repo = l.repo WHERE l.manifest_id IS NULL)
SELECT u.manifest_id, u.name, array_to_string(list_sort(list(DISTINCT s.id)), ',') AS candidates FROM (SELECT *, lower(name) AS l FROM u) u
JOIN (SELECT DISTINCT manifest_id, id, lower(v) AS v FROM (SELECT manifest_id, id, id AS v FROM sub UNION ALL SELECT manifest_id, id, name FROM sub) WHERE v <> '') s ON s.manifest_id = u.manifest_id AND (contains(u.l, s.v) OR contains(s.v, u.l)) GROUP BY 1, 2""",
    "subsystem_entities": _ENT.rstrip() + ", " + _SUB + """, o AS (SELECT e.manifest_id, e.subsystem_id AS id, e.file, e.entity_id FROM e WHERE EXISTS (SELECT 1 FROM sub s WHERE s.manifest_id = e.manifest_id AND s.id = e.subsystem_id)),
n AS (SELECT manifest_id, id, file FROM o UNION ALL SELECT o.manifest_id, u.parent_id, o.file FROM o JOIN (SELECT DISTINCT manifest_id, id, parent_id FROM sub WHERE parent_id IS NOT NULL) u ON u.manifest_id = o.manifest_id AND u.id = o.id)
SELECT manifest_id, id, count(*) AS n_entities, count(DISTINCT file) AS n_files FROM n GROUP BY 1, 2""",
    "subsystem_by_id": "WITH " + _SUB + ", m AS (SELECT id, count(*) AS n FROM sub GROUP BY 1 ORDER BY n DESC, id LIMIT 1) SELECT s.manifest_id, s.id, s.name, m.n FROM sub s JOIN m ON m.id = s.id",
    "manifest_rollup": _ENT.rstrip() + ", " + _SUB + """, c AS (SELECT manifest_id, subsystem_id AS id, count(*) AS m, count(*) FILTER (kind = 'interface') AS i, count(*) FILTER (kind IN ('function', 'method')) AS o, count(*) FILTER (kind = 'schema') AS t FROM e WHERE subsystem_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT manifest_id, parent_id AS id, count(*) AS n FROM sub WHERE parent_id IS NOT NULL GROUP BY 1, 2)
SELECT s.manifest_id, s.id, s.name, s.domain, s.status, s.dfs_ord, coalesce(c.m, 0) AS matched_entity_count, coalesce(c.i, 0) AS interface_count, coalesce(c.o, 0) AS operation_count, coalesce(c.t, 0) AS table_count, CAST(0 AS BIGINT) AS event_count, coalesce(k.n, 0) AS child_count, CAST(coalesce(len(s.dependencies), 0) AS INTEGER) AS dependency_count
FROM sub s LEFT JOIN c ON c.manifest_id = s.manifest_id AND c.id = s.id LEFT JOIN k ON k.manifest_id = s.manifest_id AND k.id = s.id""",
    "manifest_names": "WITH " + _SUB + " " + " UNION ALL ".join(f"SELECT manifest_id, id AS subsystem_id, '{c}' AS field, v AS value, '{e}' AS expected FROM (SELECT manifest_id, id, unnest({c}) AS v FROM sub) WHERE NOT regexp_matches(v, '{f}')" for c, (f, e) in validate.NAMING.items()),
    "manifest_references": "WITH " + _SUB + """ SELECT manifest_id, id AS subsystem_id, 'filePath' AS field, '' AS value, 'non-empty directory path' AS expected FROM sub WHERE coalesce(file_path, '') = ''
UNION ALL SELECT manifest_id, id, 'domain', domain, 'existing domain id' FROM sub s WHERE domain <> '' AND EXISTS (SELECT 1 FROM subsystem_domains d WHERE d.manifest_id = s.manifest_id) AND NOT EXISTS (SELECT 1 FROM subsystem_domains d WHERE d.manifest_id = s.manifest_id AND d.domain_id = s.domain)
UNION ALL SELECT s.manifest_id, s.id, 'domain', s.domain, 'same domain as parent (' || p.domain || ')' FROM sub s JOIN (SELECT DISTINCT manifest_id, id, domain FROM sub WHERE domain <> '') p ON p.manifest_id = s.manifest_id AND p.id = s.parent_id WHERE s.domain <> '' AND s.domain <> p.domain
UNION ALL SELECT manifest_id, id, 'dependencies', v, 'existing subsystem id' FROM (SELECT manifest_id, id, unnest(dependencies) AS v FROM sub) x WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sub s WHERE s.manifest_id = x.manifest_id AND s.id = x.v)""",
    "manifest_writeback": _ENT.rstrip() + ", " + _SUB + ", a AS (" + " UNION ".join(f"SELECT manifest_id, id, '{c}' AS c, unnest({c}) AS v FROM sub" for c in ("interfaces", "operations", "tables"))
    + """ UNION SELECT manifest_id, subsystem_id, 'interfaces', name FROM e WHERE kind = 'interface' AND subsystem_id IS NOT NULL UNION SELECT manifest_id, subsystem_id, 'operations', name || '()' FROM e WHERE kind IN ('function', 'method') AND subsystem_id IS NOT NULL
UNION SELECT manifest_id, subsystem_id, 'tables', name FROM e WHERE kind = 'schema' AND subsystem_id IS NOT NULL),
l AS (SELECT manifest_id, id, c, string_agg(v, ',' ORDER BY v) AS s FROM a WHERE v IS NOT NULL GROUP BY 1, 2, 3)
SELECT s.manifest_id, s.id, coalesce(i.s, '') AS interfaces, coalesce(o.s, '') AS operations, coalesce(t.s, '') AS tables FROM sub s LEFT JOIN l i ON i.manifest_id = s.manifest_id AND i.id = s.id AND i.c = 'interfaces'
LEFT JOIN l o ON o.manifest_id = s.manifest_id AND o.id = s.id AND o.c = 'operations' LEFT JOIN l t ON t.manifest_id = s.manifest_id AND t.id = s.id AND t.c = 'tables'""",
    "subsystem_filter": "WITH " + _SUB + " SELECT manifest_id, id FROM sub WHERE status = 'built' AND (contains(lower(name), 'ledger') OR contains(lower(id), 'ledger'))",
    "domain_siblings": "WITH " + _SUB + " SELECT manifest_id, id, count(*) OVER (PARTITION BY manifest_id, domain) - 1 AS siblings FROM sub",
    "bootstrap_dir_groups": "WITH " + _GROUPS + " SELECT domain, subsystem, count(*) AS n FROM k GROUP BY 1, 2",
    "bootstrap_common_prefix": """WITH d AS (SELECT repo, CASE WHEN contains(path, '/') THEN string_split(regexp_replace(path, '/[^/]*$', ''), '/') ELSE [''] END AS p FROM walked_files),
m AS (SELECT repo, min(p) AS lo, max(p) AS hi FROM d GROUP BY 1), x AS (SELECT repo, lo, coalesce(list_max(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])), 0) AS k FROM m)
SELECT repo, CASE WHEN array_to_string(lo[1:k], '/') = '' OR k = 0 THEN '.' ELSE array_to_string(lo[1:k], '/') END AS prefix FROM x""",
    "bootstrap_edges_capped": "WITH " + _CON + ", " + _NORM[len(_SUB) + 2 :] + """, w AS (SELECT a.domain AS "from", b.domain AS "to", count(*) AS weight FROM con JOIN od a ON a.manifest_id = con.manifest_id AND a.id = con."from" JOIN od b ON b.manifest_id = con.manifest_id AND b.id = con."to" WHERE a.domain <> b.domain GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY weight DESC, "to") AS rn FROM w) SELECT "from", "to", weight FROM r WHERE rn <= 8 ORDER BY weight DESC, "from", "to" LIMIT 50""",
    "unique_ids": "SELECT p_partkey, lower(p_brand) || CASE WHEN rn = 1 THEN '' ELSE '-' || CAST(rn AS VARCHAR) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS rn FROM part)",
    "palette_cycle": "WITH " + _NORM + f" SELECT manifest_id, domain, ({_PAL})[(rn - 1) % 12 + 1] AS color FROM (SELECT manifest_id, domain, row_number() OVER (PARTITION BY manifest_id ORDER BY domain) AS rn FROM (SELECT DISTINCT manifest_id, domain FROM od))",
    "graph_closure_nodes": "WITH RECURSIVE " + _CON + """, s AS (SELECT manifest_id, id FROM sub WHERE dfs_ord = 0), dn AS (SELECT manifest_id, id FROM s UNION SELECT dn.manifest_id, con."to" FROM dn JOIN con ON con.manifest_id = dn.manifest_id AND con."from" = dn.id),
up AS (SELECT manifest_id, id FROM s UNION SELECT up.manifest_id, con."from" FROM up JOIN con ON con.manifest_id = up.manifest_id AND con."to" = up.id) SELECT manifest_id, id FROM dn UNION SELECT manifest_id, id FROM up""",
    "graph_closure_edges": "WITH RECURSIVE " + _CON + """, dn AS (SELECT manifest_id, id FROM sub WHERE dfs_ord = 0 UNION SELECT dn.manifest_id, con."to" FROM dn JOIN con ON con.manifest_id = dn.manifest_id AND con."from" = dn.id)
SELECT con.manifest_id, con."from", con."to" FROM con JOIN dn ON dn.manifest_id = con.manifest_id AND dn.id = con."from\"""",
    "orphan_domains": "WITH " + _NORM + " SELECT manifest_id, id, domain FROM od",
    "edge_bundles": "WITH " + _CON + """ SELECT con.manifest_id, a.domain AS from_domain, b.domain AS to_domain, count(*) AS n_edges, count(*) > 3 AS bundled FROM con JOIN sub a ON a.manifest_id = con.manifest_id AND a.id = con."from" JOIN sub b ON b.manifest_id = con.manifest_id AND b.id = con."to"
WHERE a.domain <> b.domain GROUP BY 1, 2, 3""",
    "station_fan_out": "WITH " + _CON + """, x AS (SELECT con.manifest_id, con."from", con."to" FROM con JOIN sub a ON a.manifest_id = con.manifest_id AND a.id = con."from" JOIN sub b ON b.manifest_id = con.manifest_id AND b.id = con."to" WHERE a.domain <> b.domain),
y AS (SELECT manifest_id, "from" AS id FROM x UNION ALL SELECT manifest_id, "to" FROM x) SELECT s.manifest_id, s.id, count(y.id) AS fan_out FROM (SELECT DISTINCT manifest_id, id FROM sub) s LEFT JOIN y ON y.manifest_id = s.manifest_id AND y.id = s.id GROUP BY 1, 2""",
    "line_positions": "WITH " + _NORM + f" SELECT manifest_id, id, {_XY} FROM (SELECT manifest_id, id, row_number() OVER (PARTITION BY manifest_id, domain ORDER BY id) - 1 AS position FROM od)",
    "compact_positions": "WITH " + _NORM + """, v AS (SELECT o.*, row_number() OVER (PARTITION BY o.manifest_id, o.domain ORDER BY o.id) - 1 AS i, count(*) OVER (PARTITION BY o.manifest_id, o.domain) AS n FROM od o JOIN sub s ON s.manifest_id = o.manifest_id AND s.id = o.id WHERE s.status = 'built')
SELECT manifest_id, id, CAST((max(n) OVER (PARTITION BY manifest_id) - n) * 420 / 2.0 + i * 420 AS DOUBLE) AS x, CAST((dense_rank() OVER (PARTITION BY manifest_id ORDER BY domain) - 1) * 320 AS INTEGER) AS y FROM v""",
    "visible_edges": "WITH " + _CON + """ SELECT CAST(con.manifest_id AS VARCHAR) || '/' || con."from" AS source, CAST(con.manifest_id AS VARCHAR) || '/' || con."to" AS target FROM con
WHERE EXISTS (SELECT 1 FROM sub s WHERE s.manifest_id = con.manifest_id AND s.id = con."from" AND s.status = 'built') AND EXISTS (SELECT 1 FROM sub s WHERE s.manifest_id = con.manifest_id AND s.id = con."to" AND s.status = 'built')""",
    "visible_lines": "WITH " + _NORM + " SELECT manifest_id, domain FROM od GROUP BY 1, 2 HAVING count(DISTINCT id) >= 2",
    "partition_slices": f"WITH d AS (SELECT DISTINCT {_TOP} AS directory FROM walked_files), r AS (SELECT directory, row_number() OVER (ORDER BY directory) - 1 AS i, count(*) OVER () AS n FROM d), a AS (SELECT unnest(range(5)) AS a) SELECT CAST(a + 1 AS INTEGER) AS agent, directory FROM r, a WHERE i >= (n * a) // 5 AND i < (n * (a + 1)) // 5",
    "partition_round_robin": f"WITH d AS (SELECT {_TOP} AS directory, count(*) AS n_files FROM walked_files GROUP BY 1) SELECT CAST((row_number() OVER (ORDER BY n_files DESC, directory) - 1) % 5 + 1 AS INTEGER) AS agent, directory, n_files FROM d",
    "dirs_collect": "SELECT repo, string_agg(d, ', ' ORDER BY d) AS directories FROM (SELECT DISTINCT repo, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS d FROM walked_files) GROUP BY 1",
}
SQL["manifest_report"] = f"""WITH a AS ({SQL['manifest_names']}), b AS ({SQL['manifest_references']}) SELECT manifest_id, field, count(*) FILTER (k = 1) AS n_naming, count(*) FILTER (k = 2) AS n_references, count(DISTINCT subsystem_id) AS n_subsystems FROM (SELECT manifest_id, subsystem_id, field, 1 AS k FROM a UNION ALL SELECT manifest_id, subsystem_id, field, 2 FROM b) GROUP BY 1, 2"""
