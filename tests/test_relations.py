"""Queries that take all rows of their tables, against brute force on small tables."""

import hashlib

import pytest

from codeloom.plans import relations

ENTITIES = "entity_id long, repo string, name string, kind string, file string, line int, language string, build_status string, confidence string, manifest_id long, subsystem_id string"
SUBSYSTEMS = "manifest_id long, id string, name string, domain string, status string, file_path string, interfaces array<string>, operations array<string>, tables array<string>, events array<string>, dependencies array<string>, parent_id string, depth int, dfs_ord int, registered_at timestamp"
ROWS = [
    (1, "o/r", "Ledger", "interface", "./lib/a.ts", 3, "TypeScript", "built", "high", 1, "ledger"),
    (1, "o/r", "Ledger", "interface", "./lib/a.ts", 3, "TypeScript", "built", "high", 1, "ledger"),
    (2, "o/r", "helper", "function", "src/ledger/b.ts", None, "TypeScript", "built", "high", 1, None),
    (3, "o/r", "LedgerStore", "class", "lib/c.ts", 9, "TypeScript", "unbuilt", "low", 1, "ledger"),
    (4, "o/r", "ledger_audit", "class", "lib/d.ts", None, "TypeScript", "built", "low", None, None),
    (5, "o/r", "Quarry", "class", "src/ledger/e.ts", 2, "TypeScript", "built", "low", None, None),
    (6, "o/r", "Unlike", "class", "lib/f.ts", 2, "TypeScript", "built", "low", 2, "quarry"),
    (7, "p/q", "Ledger", "interface", "lib/a.ts", 3, "TypeScript", "built", "high", 3, "other"),
]
SUBS = [
    (1, "ledger", "Ledger Core", "d", "built", "src/ledger/", ["Ledger"], [], [], [], [], None, 0, 0, None),
    (2, "quarry", "Quarry", "d", "built", "src/quarry", [], [], [], None, None, None, 0, 0, None),
    (3, "other", "Other", "d", "built", None, None, None, None, None, None, None, 0, 0, None),
]

HEAD, CLASS = "// a long first line with a wide letter: \u00e9, so that no entity lies in the first bytes\n", "export class Ledger {\n  total(): number { return 1; }\n}"
FILES = [(i, "o/r", path, "TypeScript", text.encode(), None, len(text.encode())) for i, (path, text) in enumerate([("lib/a.ts", HEAD + CLASS + "\n"), ("lib/z.ts", "//\n")])]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(ROWS, ENTITIES).write.parquet(f"{folder}/entity_summaries.parquet")
    spark.createDataFrame(SUBS, SUBSYSTEMS).write.parquet(f"{folder}/subsystems.parquet")
    spark.createDataFrame(FILES, "file_id long, repo string, path string, language string, content binary, mtime timestamp, size long").write.parquet(f"{folder}/walked_files.parquet")
    return str(folder)


def test_candidates_of_unmatched(spark, root):
    got = {(r["manifest_id"], r["name"]): r["candidates"] for r in relations.QUERIES["manifest_candidates"](spark, root).collect()}
    # helper and the first Ledger are matched; Unlike and the Ledger of manifest 3 are like no subsystem; ledger_audit and Quarry have no manifest
    assert got == {(1, "LedgerStore"): "ledger", (1, "ledger_audit"): "ledger", (2, "Quarry"): "quarry"}


def test_markdown_of_all_entities(spark, root):
    got = sorted(r["line"] for r in relations.QUERIES["export_markdown_lines"](spark, root).collect())
    rows = {(e, n, k, f"{repo}/{f.removeprefix('./')}", x, lang, b) for e, repo, n, k, f, x, lang, b, *_ in ROWS}
    assert got == sorted(f"| {n} | {k} | {f} | {'' if x is None else x} | {lang} | {b} |" for _, n, k, f, x, lang, b in rows)
    assert sum(" |  | " in line for line in got) == 2


def test_scanned_entities_are_matched_or_not(spark, root):
    out = relations.QUERIES["manifest_match"](spark, root).collect()
    assert len(out) == len(set(ROWS))  # the row stored twice counts once
    got = {r["entity_id"]: (r["subsystem_id"], r["match_strategy"]) for r in out}
    none = (None, None)
    assert got == {1: ("ledger", "name_match"), 2: ("ledger", "file_path"), 3: none, 4: none, 5: none, 6: none, 7: none}
    (total,) = relations.QUERIES["manifest_coverage"](spark, root).collect()
    assert (total["total_entities"], total["n_matched"]) == (7, 2) and abs(total["coverage_percent"] - 200 / 7) < 1e-9


def test_slices_are_entities(spark, root):
    out = relations.QUERIES["source_slices"](spark, root).collect()
    content = {f"{repo}/{path}": c for _, repo, path, _, c, *_ in FILES}
    (ledger,) = [r for r in out if r["kind"] == "class"]
    assert ledger["start"] >= len(HEAD.encode()) > 40 and b"class Ledger" in content[ledger["path"]][ledger["start"] : ledger["end"]]
    for r in out:
        assert r["digest"] == hashlib.sha256(content[r["path"]][r["start"] : r["end"]]).hexdigest()


def test_hits_of_scanned_files(spark, root):
    (got,) = relations.QUERIES["cache_hit_miss"](spark, root).collect()
    assert (got["hits"], got["misses"]) == (1, 1)
