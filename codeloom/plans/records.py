"""Queries of the record operators: hierarchies, flat tables, dead references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import flatten, hierarchy, orphans
from codeloom.runtime import read


def _hierarchy(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return hierarchy.hierarchy(read(spark, root, "subsystems"), kind).withColumnsRenamed({"scope": "manifest_id", "node": "id"})


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return _hierarchy(spark, root, "circles")


def p1_nodes(spark: SparkSession, root: str) -> DataFrame:
    return _hierarchy(spark, root, "nodes").withColumn("roots", F.array_join("roots", ","))


def p1_paths(spark: SparkSession, root: str) -> DataFrame:
    return _hierarchy(spark, root, "paths").withColumn("path", F.array_join("path", "/"))


def p1_descendants(spark: SparkSession, root: str) -> DataFrame:
    return _hierarchy(spark, root, "descendants")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return flatten.flat_rows(read(spark, root, "raw_manifests"), read(spark, root, "resolution_results"))


def p2_subsystems(spark: SparkSession, root: str) -> DataFrame:
    rows = flatten.flatten_subsystems(read(spark, root, "raw_manifests"))
    lists = {x: F.array_join(x, ",") for x in ("interfaces", "operations", "tables", "events", "dependencies")}
    return rows.withColumns(lists)


def p2_links(spark: SparkSession, root: str) -> DataFrame:
    return flatten.flatten_links(read(spark, root, "resolution_results"))


def p2_exports(spark: SparkSession, root: str) -> DataFrame:
    return flatten.flatten_exports(read(spark, root, "resolution_results"))


def _references(spark: SparkSession, root: str) -> list[DataFrame]:
    return [read(spark, root, x) for x in ("subsystems", "subsystem_domains", "entity_summaries")]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphans(*_references(spark, root))


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_report(*_references(spark, root))


QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_paths, p1_descendants, p2_found, p2_subsystems, p2_links, p2_exports, p4_found, p4_report)}

_REACH = """
WITH RECURSIVE n AS (SELECT DISTINCT manifest_id, id FROM subsystems WHERE manifest_id IS NOT NULL AND id IS NOT NULL),
e AS (SELECT DISTINCT s.manifest_id, s.id AS child, s.dep AS parent
      FROM (SELECT manifest_id, id, unnest(dependencies) AS dep FROM subsystems) s
      JOIN n ON n.manifest_id = s.manifest_id AND n.id = s.dep
      WHERE s.id IS NOT NULL AND s.dep <> ''),
r AS (SELECT manifest_id, child, parent FROM e
      UNION
      SELECT r.manifest_id, r.child, e.parent FROM r JOIN e ON e.manifest_id = r.manifest_id AND e.child = r.parent)
"""

_REFS = """
WITH refs AS (
  SELECT 'subsystems' AS ref_table, 'dependencies' AS ref_field, manifest_id, id AS source_key, unnest(dependencies) AS ref_value, synced_at AS t FROM subsystems
  UNION SELECT 'subsystems', 'domain', manifest_id, id, domain, synced_at FROM subsystems
  UNION SELECT 'entity_summaries', 'subsystem_id', manifest_id, CAST(entity_id AS VARCHAR), subsystem_id, scanned_at FROM entity_summaries),
live AS (SELECT * FROM refs WHERE ref_value IS NOT NULL AND ref_value <> ''),
gone AS (SELECT * FROM live r WHERE CASE WHEN ref_field = 'domain'
  THEN NOT EXISTS (SELECT 1 FROM subsystem_domains d WHERE d.manifest_id = r.manifest_id AND d.domain_id = r.ref_value AND d.registered_at <= r.t AND (d.deleted_at IS NULL OR d.deleted_at > r.t))
  ELSE NOT EXISTS (SELECT 1 FROM subsystems s WHERE s.manifest_id = r.manifest_id AND s.id = r.ref_value AND s.registered_at <= r.t AND (s.deleted_at IS NULL OR s.deleted_at > r.t)) END)
"""

_LINKS = """
WITH l AS (SELECT record_id, unnest(impl_links) AS x, unnest(range(len(impl_links))) AS pos FROM resolution_results)
SELECT DISTINCT record_id, '' AS parent_key, CAST(pos AS BIGINT) AS pos, x.interface_name AS interface_name, x.implementor AS child_key, x.impl_file AS impl_file, x.interface_file AS interface_file FROM l WHERE x IS NOT NULL
"""

_EXPORTS = """
WITH m AS (SELECT record_id, unnest(map_entries(exports_by_file)) AS e FROM resolution_results),
l AS (SELECT record_id, e.key AS parent_key, unnest(e.value) AS x, unnest(range(len(e.value))) AS pos FROM m)
SELECT DISTINCT record_id, parent_key, CAST(pos AS BIGINT) AS pos, x.name AS child_key, x.origin_file AS origin_file, x.via_file AS via_file FROM l WHERE x IS NOT NULL
"""

_TREE = """
WITH RECURSIVE t AS (
  SELECT DISTINCT record_id, '' AS parent_key, CAST(j.key AS BIGINT) AS pos, j.value AS node
  FROM (SELECT record_id, CAST(body AS JSON) AS body FROM raw_manifests WHERE json_valid(body)) m, json_each(m.body, '$.subsystems') j WHERE j.key IS NOT NULL
  UNION
  SELECT t.record_id, t.node ->> '$.id', CAST(j.key AS BIGINT), j.value FROM t, json_each(t.node, '$.children') j WHERE j.key IS NOT NULL)
"""

_TRAILS = (
    _REACH.rstrip()
    + """,
c AS (SELECT a.manifest_id, a.child AS id, min(a.parent) AS circle FROM r a JOIN r b ON b.manifest_id = a.manifest_id AND b.child = a.parent AND b.parent = a.child GROUP BY 1, 2),
o AS (SELECT n.manifest_id, n.id, c.circle, coalesce(c.circle, n.id) AS head FROM n LEFT JOIN c ON c.manifest_id = n.manifest_id AND c.id = n.id),
k AS (SELECT DISTINCT manifest_id, head, circle IS NOT NULL AS ring FROM o),
h AS (SELECT DISTINCT e.manifest_id, a.head AS node, b.head AS up FROM e JOIN o a ON a.manifest_id = e.manifest_id AND a.id = e.child JOIN o b ON b.manifest_id = e.manifest_id AND b.id = e.parent WHERE a.head <> b.head),
t AS (SELECT manifest_id, head AS place, head AS root, [head] AS path, ring AS hit FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.manifest_id = k.manifest_id AND h.node = k.head)
  UNION ALL SELECT t.manifest_id, h.node, t.root, list_append(t.path, h.node), t.hit OR k.ring FROM t JOIN h ON h.manifest_id = t.manifest_id AND h.up = t.place JOIN k ON k.manifest_id = h.manifest_id AND k.head = h.node)
"""
)
_LIST = "CASE WHEN json_type(node, '$.{0}') = 'ARRAY' THEN coalesce(array_to_string(json_extract_string(node, '$.{0}[*]'), ','), '') END AS {0}"

SQL = {
    "p1_nodes": _TRAILS
    + """, s AS (SELECT manifest_id, place, CAST(max(len(path)) - 1 AS INTEGER) AS depth, array_to_string(list_sort(list_distinct(list(root))), ',') AS roots, CAST(count(*) AS DOUBLE) AS n_paths FROM t GROUP BY 1, 2),
d AS (SELECT manifest_id, parent AS id, count(*) AS n FROM r GROUP BY 1, 2)
SELECT o.manifest_id, o.id, o.circle IS NOT NULL AS in_circle, o.circle, s.depth, s.roots, s.n_paths, coalesce(d.n, 0) AS n_descendants FROM o JOIN s ON s.manifest_id = o.manifest_id AND s.place = o.head LEFT JOIN d ON d.manifest_id = o.manifest_id AND d.id = o.id""",
    "p1_paths": _TRAILS
    + "SELECT o.manifest_id, o.id, t.root, array_to_string(list_append(t.path[1:len(t.path) - 1], o.id), '/') AS path, CAST(len(t.path) - 1 AS INTEGER) AS depth, t.hit AS through_circle FROM t JOIN o ON o.manifest_id = t.manifest_id AND o.head = t.place",
    "p2_subsystems": _TREE.replace("j.value AS node", "j.value AS node, 0 AS depth").replace("CAST(j.key AS BIGINT), j.value FROM t", "CAST(j.key AS BIGINT), j.value, t.depth + 1 FROM t")
    + "SELECT DISTINCT record_id, parent_key, pos, node ->> '$.id' AS child_key, CAST(depth AS INTEGER) AS depth, node ->> '$.name' AS name, node ->> '$.domain' AS domain, node ->> '$.status' AS status, node ->> '$.filePath' AS file_path, "
    + ", ".join(_LIST.format(x) for x in ("interfaces", "operations", "tables", "events", "dependencies"))
    + " FROM t",
    "p1_found": _REACH + "SELECT DISTINCT manifest_id, child AS id FROM r WHERE child = parent",
    "p1_descendants": _REACH + "SELECT manifest_id, parent AS id, child AS descendant FROM r",
    "p2_found": _TREE
    + f"""SELECT DISTINCT record_id, 'subsystems' AS section, parent_key, pos, node ->> '$.id' AS child_key FROM t
UNION SELECT record_id, 'impl_links', parent_key, pos, child_key FROM ({_LINKS}) a
UNION SELECT record_id, 'exports_by_file', parent_key, pos, child_key FROM ({_EXPORTS}) b""",
    "p2_links": _LINKS,
    "p2_exports": _EXPORTS,
    "p4_found": _REFS + "SELECT DISTINCT ref_table, ref_field, manifest_id, source_key, ref_value FROM gone",
    "p4_report": _REFS
    + """, a AS (SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n FROM live GROUP BY ALL),
b AS (SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(*) AS n FROM gone GROUP BY ALL)
SELECT a.ref_table, a.ref_field, a.month, a.n AS n_references, coalesce(b.n, 0) AS n_orphans, round(coalesce(b.n, 0) / a.n, 6) AS orphan_rate
FROM a LEFT JOIN b ON a.ref_table = b.ref_table AND a.ref_field = b.ref_field AND a.month IS NOT DISTINCT FROM b.month""",
}
