"""Scanners, resolver, rules, manifests, graphs, stores, outputs and checks on small inputs."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.extract import scanner
from codeloom.extract.text import decorator_arg, split_top, strip_quotes
from codeloom.functions import names, paths
from codeloom.operators import bootstrap, cache, graph, inputcheck, manifest, query, resolve, sinks, tables, validate, work
from codeloom.sources import files as sources

FILES = {
    "src/types.ts": 'export interface EventHandler {\n  handle(e: string): void;\n  cleanup(): void;\n}\nexport interface Repository<T> {\n  find(id: string): T;\n}\n',
    "src/handler.ts": 'import { EventHandler } from "./types";\nexport class LogEventHandler implements EventHandler {\n  handle(e: string): void {}\n  cleanup(): void {}\n}\nexport class MetricsHandler implements EventHandler {\n  async handle(e: string): Promise<void> {}\n}\n',
    "src/repo.ts": 'import * as t from "./types";\nexport { EventHandler as Handler } from "./types";\nclass UserRepo implements Repository<User> {\n  constructor(private db: Db) {}\n  find(id: string): User { return null; }\n}\nexport default UserRepo;\n',
}


@pytest.fixture(scope="module")
def ir(spark):
    rows = [(p, "TypeScript", t.encode(), None, "clash") for p, t in FILES.items()]
    df = spark.createDataFrame(rows, "path string, language string, content binary, content_hash string, build_status string")
    return scanner.ir_files(df).cache()


def test_cross_file(ir):
    assert {r["name"] for r in query.search(tables.entities(ir), "Repo").collect()} == {"UserRepo", "Repository"}
    links = query.implementors(tables.implements(ir)).collect()
    assert {r["interface_name"]: r["implementors"] for r in links} == {"EventHandler": ["LogEventHandler", "MetricsHandler"], "Repository<User>": ["UserRepo"]}
    gaps = resolve.missing_methods(tables.implements(ir), tables.interface_methods(ir), tables.methods(ir)).collect()
    assert [(r["implementor"], r["missing"]) for r in gaps] == [("MetricsHandler", ["cleanup"])]
    imports = resolve.resolve_imports(tables.imports(ir), resolve.path_index(ir))
    assert {(r["file"], r["resolved_path"], tuple(r["symbols"])) for r in imports.collect()} == {("src/handler.ts", "src/types.ts", ("EventHandler",)), ("src/repo.ts", "src/types.ts", ("*",))}
    sources_ = resolve.resolve_imports(resolve.export_sources(tables.exports(ir)), resolve.path_index(ir))
    exports = {(r["file"], r["name"]): (r["origin_file"], r["via_file"]) for r in resolve.resolve_exports(tables.exports(ir), sources_).collect()}
    assert exports["src/repo.ts", "Handler"] == ("src/types.ts", "src/repo.ts") and exports["src/types.ts", "Repository"] == ("src/types.ts", None)
    bad = {(r["rule"], r["entity_name"]) for r in validate.violations(ir).collect()}
    assert ("interfaces-have-implementors", "Repository") in bad  # implemented with type arguments, so under another name
    assert validate.exit_status(1, 0) == 0 and validate.exit_status(1, 0, True) == 1 and validate.exit_status(0, 1) == 1


def test_broken_files_never_end_the_job(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(240):
        text = "".join(FILES.values())
        cut = text[: rnd.randrange(len(text))] + rnd.choice(["", "{", "'", "/*", "\x00", "é", "((("]) * rnd.randrange(3)
        rows.append((f"f{i}", rnd.choice([*scanner.SCANNERS, None, "Cobol"]), rnd.choice([cut.encode(), cut.encode("utf-16"), b"", None])))
    df = spark.createDataFrame(rows, "path string, language string, content binary")
    out = scanner.ir_files(df).select("path", "error").collect()
    known = [r for r in rows if r[1] in scanner.SCANNERS and r[2] is not None]
    assert len(out) == len(known) and not [r for r in out if r["error"]]
    assert scanner.ir_files(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.sampled_from(sorted(scanner.SCANNERS)))
def test_any_text_can_be_scanned(text, language):
    out = scanner.scan(text.encode(), language, "x")
    assert set(out) == set(schema.ENTITIES)


def test_large_interface():
    text = "export interface Big {\n" + "".join(f"  m{i}(a: string): void;\n" for i in range(1000)) + "}\n"
    assert len(scanner.scan(text.encode(), "TypeScript", "x")["interfaces"][0]["methods"]) == 1000


def test_text_helpers():
    assert decorator_arg('Get("/a(b)")') == "/a(b)" and decorator_arg("Get") == "" and strip_quotes("'a'") == "a"
    assert split_top("a, b<c, d>, (e, f), {g: 1, h: 2}") == ["a", "b<c, d>", "(e, f)", "{g: 1, h: 2}"]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_paths(spark):
    lit = F.lit
    assert value(spark, paths.has_prefix(lit("src/auth/x"), lit("src/auth"))) and not value(spark, paths.has_prefix(lit("src/authz/x"), lit("src/auth/")))
    assert value(spark, paths.normalized(lit("a/./b/../../../c"))) == "c" and value(spark, paths.normalized(lit("a/../../c"), True)) == "../c"
    assert value(spark, paths.ancestors(lit("/a/b"))) == ["/", "/a", "/a/b"] and value(spark, paths.depth(lit("/"))) == 1
    assert value(spark, paths.language(lit("a/.rs"))) is None and value(spark, paths.language(lit("a.b/c.TS"))) is None and value(spark, paths.language(lit("x.d.ts"))) == "TypeScript"
    assert value(spark, paths.included(lit("src/a/b.ts"), ["src/*.ts"], [])) and not value(spark, paths.included(lit("src/a.ts"), [], ["**/*.{ts,js}"]))
    assert value(spark, names.humanized(lit("api-dataStore_x"))) == "Api DataStore X"


def test_status_and_schema(spark):
    assert [value(spark, schema.confidence(F.lit(s))) for s in (*schema.BUILD_STATUS, "x")] == ["high", "low", "medium", "low", None]
    assert value(spark, schema.status_of_manifest(F.lit("BoilerPlate"))) == "unbuilt"
    made = schema.json_schema(schema.ir_type(), "IrFile")
    assert made["properties"]["interfaces"]["items"]["properties"]["methods"]["type"] == "array" and made["title"] == "IrFile"


MANIFEST = {
    "meta": {"name": "m"},
    "subsystems": [
        {"id": "auth", "name": "Auth", "domain": "d", "status": "Built", "filePath": "src/auth", "interfaces": ["Login"], "operations": ["signIn()"], "children": [{"id": "auth-jwt", "name": "JWT", "status": "new", "filePath": "src/auth/jwt", "zzz": 1}]},
        {"id": "billing", "name": "Billing", "status": "rebuild", "filePath": "src/*/bill*", "tables": ["invoices"], "events": ["a.b"], "dependencies": ["auth"]},
    ],
}


def test_manifest(spark):
    flat = manifest.flatten(json.dumps(MANIFEST))
    assert [(s["id"], s["parent_id"], s["depth"], s["dfs_ord"]) for s in flat] == [("auth", None, 0, 0), ("auth-jwt", "auth", 1, 1), ("billing", None, 0, 2)]
    with pytest.raises(ValueError):
        manifest.flatten({"subsystems": [{"id": "x", "name": "x", "status": "odd"}]})
    keys = "manifest_id long, id string, name string, domain string, status string, file_path string, interfaces array<string>, operations array<string>, tables array<string>, events array<string>, dependencies array<string>, parent_id string, depth int, dfs_ord int"
    subs = spark.createDataFrame([(1, s["id"], s["name"], s["domain"], s["status"], s["file_path"], s["interfaces"], s["operations"], s["tables"], s["events"], s["dependencies"], s["parent_id"], s["depth"], s["dfs_ord"]) for s in flat], keys)
    ents = [("A", "class", "src/auth/jwt/a.ts"), ("B", "class", "src/auth/b.ts"), ("C", "class", "src/authz/c.ts"), ("Login", "class", "x/l.ts"), ("signIn", "function", "x/s.ts"), ("invoices", "schema", "x/i.ts"), ("invoices", "class", "x/i.ts"), ("D", "class", "src/q/billing/d.ts"), ("bill", "class", "x/y.ts")]
    df = spark.createDataFrame([(1, *e) for e in ents], "manifest_id long, name string, kind string, file string")
    got = {(r["name"], r["kind"]): (r["subsystem_id"], r["match_strategy"]) for r in manifest.match(df, subs).collect()}
    assert got[("A", "class")] == ("auth-jwt", "file_path") and got[("B", "class")] == ("auth", "file_path") and got[("C", "class")] == (None, None)
    assert got[("Login", "class")] == ("auth", "name_match") and got[("signIn", "function")] == ("auth", "name_match") and got[("invoices", "schema")][0] == "billing" and got[("invoices", "class")][0] is None
    assert got[("D", "class")] == ("billing", "file_path")
    assert manifest.coverage(manifest.match(df.limit(0), subs)).first()["coverage_percent"] == 100.0
    loose = manifest.candidates(df.where("name = 'bill'"), subs).first()
    assert loose["candidates"] == ["billing"]
    doms = spark.createDataFrame([(1, "other")], "manifest_id long, domain_id string")
    faults = {(r["subsystem_id"], r["field"], r["expected"]) for r in validate.manifest_references(subs, doms, spark.createDataFrame([(1, "auth", "gone")], "manifest_id long, from string, to string")).collect()}
    assert faults == {("auth", "domain", "existing domain id"), ("gone", "connections.to", "existing subsystem id")}


def test_layers_break_circles_at_the_lightest_edge():
    depth, cuts = graph.layer(["a", "b", "c", "d"], {("a", "b"): 3, ("b", "c"): 1, ("c", "a"): 2, ("c", "d"): 1})
    assert cuts == [("b", "c")] and depth == {"c": 0, "a": 1, "d": 1, "b": 2}
    assert graph.layer([], {}) == ({}, [])


def test_grid_and_lines(spark):
    rows = [(1, f"d{i}", 0 if i < 5 else 1, 10 - i) for i in range(7)]
    got = {r["domain"]: (r["row"], r["col"]) for r in graph.grid(spark.createDataFrame(rows, "manifest_id long, domain string, topo_depth int, station_count long")).collect()}
    assert got == {"d0": (0, 0), "d1": (0, 1), "d2": (0, 2), "d3": (1, 0), "d4": (1, 1), "d5": (2, 0), "d6": (2, 1)}
    x, y = graph.line_offset(F.col("id"))
    at = spark.range(22).select("id", x.alias("x"), y.alias("y")).collect()
    assert (at[9]["x"], at[9]["y"]) == (9 * 420, 0) and (at[10]["x"], at[10]["y"]) == (9 * 420, 320) and (at[19]["x"], at[20]["x"], at[20]["y"]) == (0, 0, 640)


def test_bootstrap(spark):
    cases = {"a.ts": ("_root", "a.ts"), "x/a.ts": ("x", "x"), "crates/core/src/a.rs": ("core", "core"), "crates/core/src/sub/a.rs": ("core", "sub"), "crates/core/net/a.rs": ("core", "net"), "crates/core/a.rs": ("core", "core"), "docs/x/a.ts": ("docs", "x"), "src/app/lib/a.ts": ("app", "app")}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r["path"]: (r["domain"], r["subsystem"]) for r in bootstrap.directory_groups(df).collect()} == cases
    groups = spark.createDataFrame([("g", "a/b/c/x.ts"), ("g", "a/b/d/y.ts"), ("h", "q.ts"), ("h", "a/z.ts"), ("i", "m/n/o.ts")], "k string, path string")
    assert {r["k"]: r["prefix"] for r in bootstrap.common_prefix(groups, ["k"]).collect()} == {"g": "a/b", "h": ".", "i": "m/n"}
    subs = bootstrap.subsystems(df, 99)
    assert {r["id"] for r in subs.collect()} == {"_root", "x", "core", "docs", "app"}
    files = spark.createDataFrame([("auth/a.ts",), ("bill/b.ts",)], "path string")
    known = spark.createDataFrame([("auth", "Auth", "auth"), ("bill", "Bill Pay", "bill")], "id string, name string, file_path string")
    imports = spark.createDataFrame([("auth/a.ts", "../bill/b"), ("auth/a.ts", "crate::bill-pay::x"), ("bill/b.ts", "./c"), ("bill/b.ts", "nothing")], "file string, source string")
    links = bootstrap.connections(files, imports, known).collect()
    assert [(r["from"], r["to"], r["weight"]) for r in links] == [("auth", "bill", 2)]
    assert json.loads(bootstrap.manifest("m", known.withColumns({"domain": F.lit("d-x"), "status": F.lit("new")}), bootstrap.connections(files, imports, known)))["domains"]["d-x"]["label"] == "D X"


def test_work(spark):
    assert [work.strategy(n) for n in (499, 500, 2000, 2001)] == ["by_concern", "hybrid", "hybrid", "by_directory"]
    df = spark.createDataFrame([(f"d{i}/f",) for i in range(7)], "path string")
    for k in (1, 3, 5, 9):
        got = {r["directory"]: r["agent"] for r in work.slices(df, k).collect()}
        assert got == {f"d{j}": a + 1 for a in range(k) for j in range(7 * a // k, 7 * (a + 1) // k)}


def test_prompt(ir):
    text = work.prompt(work.by_concern(ir), "scan", {"Files": 3})
    assert "## Agent 1: interfaces" in text and "Directories: src" in text


def test_sources_cache_and_sinks(spark, ir, tmp_path):
    for p, t in {**FILES, "src/.hidden.ts": "x", "node_modules/a.ts": "x", "README.md": "x"}.items():
        (tmp_path / "tree" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / p).write_text(t)
    found = sources.walk(spark, str(tmp_path / "tree"), ignore=["node_modules/", "# note"])
    assert {r["path"] for r in found.collect()} == set(FILES)
    assert sources.walk(spark, str(tmp_path / "tree"), include=["**/repo.ts"]).count() == 1
    records = scanner.ir_files(found)
    cache.write(records, str(tmp_path / "store"))
    store = cache.load(spark, str(tmp_path / "store"))
    hits, misses = cache.split(found.withColumn("path", F.when(F.col("path").endswith("repo.ts"), "other.ts").otherwise(F.col("path"))), store)
    assert (hits.count(), misses.count()) == (2, 1)
    again = cache.rescan(found, store, scanner.ir_files)
    assert tables.entities(again).count() == tables.entities(records).count()
    masked = sinks.apply_mask(ir, "path,interfaces.name")
    assert masked.schema["interfaces"].dataType.elementType.fieldNames() == ["name"]
    with pytest.raises(ValueError, match="unknown fields"):
        sinks.apply_mask(ir, "nope.x")
    line = json.loads(sinks.json_lines(tables.entities(ir).select("name", "line", "kind").where("name = 'UserRepo'")).first()["value"])
    assert list(line) == ["kind", "line", "name"]
    assert sinks.csv_lines(tables.entities(ir).where("name = 'UserRepo'")).first()["line"] == '"UserRepo",Class,"src/repo.ts",2,TypeScript,Built'
    assert sinks.text_table(spark.createDataFrame([(1, None)], "a int, b string")).startswith("a  b")
    spans = spark.createDataFrame([("src/repo.ts", 0, 6), ("src/repo.ts", 5, 99_999)], "path string, start long, end long")
    assert {r["source"] for r in sources.slice_source(found, spans).collect()} == {"import", None}


def test_build_status(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, mtime int, content binary")
    state = lambda rows, **k: sources.build_status(make(rows), **k).first()[0]
    assert state([("a.ts", 1, b"")]) == "unbuilt"
    assert state([("a.ts", 1, b""), ("dist/a.js", 2, b"")]) == "built"
    assert state([("a.ts", 3, b""), ("dist/a.js", 2, b"")]) == "error"
    assert state([("a.ts", 1, b""), ("dist/a.js", 2, b""), ("yarn.lock", 1, b"x\n<<<<<<< a\n")]) == "error"
    assert state([("a.ts", 1, b""), ("dist/a.js", 2, b"")], uncommitted=11) == "rebuild"


def test_evict(spark):
    rnd = random.Random(4)
    rows = [(f"p{i}", rnd.randrange(6), rnd.randrange(1, 50)) for i in range(60)]
    got = {r["path"] for r in cache.evict(spark.createDataFrame(rows, "path string, last_accessed int, size int"), 400).collect()}
    left, total = set(), 0
    for p, _, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        total += n
        if total <= 400:
            left.add(p)
    assert got == left


@pytest.mark.parametrize(
    ("check", "bad", "code"),
    [
        (inputcheck.check_text, "a\x01", "control_characters"), (inputcheck.check_text, "x" * 10_001, "too_long"), (inputcheck.check_path, "a/../b", "traversal"), (inputcheck.check_path, "a\0", "nul"),
        (inputcheck.check_id, "a?b", "bad_id"), (inputcheck.check_pattern, "(", "bad_pattern"), (inputcheck.check_json, "{", "bad_json"), (inputcheck.check_json, "[" * 40 + "]" * 40, "too_deep"),
    ],
)
def test_input_checks(check, bad, code):
    with pytest.raises(inputcheck.InputError) as e:
        check(bad)
    assert e.value.code == code


def test_depth_and_payload():
    assert inputcheck.depth(1) == 0 and inputcheck.depth([]) == 1 and inputcheck.depth({"a": [1]}) == 2
    assert inputcheck.payload('{"name": "x"}', {"name"}, {}) == {"name": "x"}
    for text, flags in (('{"zzz": 1}', {}), ('{"name": 1}', {"name": "y"}), ("[1]", {})):
        with pytest.raises(inputcheck.InputError):
            inputcheck.payload(text, {"name"}, flags)


def test_streaming(spark, tmp_path):
    from codeloom.streaming import ingest

    folder = str(tmp_path / "in")
    rows = [(p, "TypeScript", t.encode()) for p, t in FILES.items()]
    kind = "path string, language string, content binary"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, kind).write.mode("append").parquet(folder)
        ingest.ingest(spark, folder, kind, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert cache.load(spark, str(tmp_path / "store")).count() == 3


def test_nested_ignore_files_and_walk_order(spark, tmp_path):
    for name in ("a/x.ts", "a/gen/y.ts", "a/gen/keep.ts", "a.b/z.ts", "b/gen/y.ts", "b/skip.ts", "b/c/skip.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export class A {}")
    (tmp_path / ".gitignore").write_text("# all\nskip.ts\n")
    (tmp_path / "a/.gitignore").write_text("gen/\n!keep.ts\n")
    (tmp_path / "b/c/.gitignore").write_text("!skip.ts\n")
    found = sources.walk(spark, str(tmp_path))
    left = sources.without_ignored(found, sources.ignore_rules(sources.ignore_files(found, str(tmp_path))))
    assert [r["path"] for r in sources.in_walk_order(left).orderBy("walk_ord").collect()] == ["a/gen/keep.ts", "a/x.ts", "a.b/z.ts", "b/c/skip.ts", "b/gen/y.ts"]


def test_further_lookups(spark):
    ir = scanner.ir_files(spark.createDataFrame([("src/a.ts", "TypeScript", b"@Controller('/p')\nexport class S { @Get('/x')\n async go(): Promise<void> {} }\nexport interface I { m(): void }\n"), ("lib/b.rs", "Rust", b"impl T for X { fn m(&self) {} }")], "path string, language string, content binary"))
    from codeloom.operators import query, sinks, tables, work

    assert [tuple(r) for r in query.service_table(ir, show_routes=True).collect()] == [("S", "src/a.ts", "http_controller", 1, ["GET /x"])]
    assert query.impl_table(ir, "T", True).first()["methods"] == ["m"] and query.interfaces(ir, "I", True).first()["methods"] == ["m"]
    assert {r["owner_kind"] for r in query.method_filter(tables.methods(ir), is_async=True).collect()} == {"class", "service"}
    assert query.file_by_path(ir, "lib/b.rs").count() == 1 and query.build_status_map(ir).count() == 2
    dealt = {(r["agent"], r["path"]) for r in work.hybrid(ir, 3).collect()}
    assert {a for a, _ in dealt} >= {1, 2, 3} and {p for _, p in dealt} == {"src/a.ts", "lib/b.rs"}
    assert [r[0] for r in sinks.table_lines(spark.createDataFrame([("a", None), ("bbbbbbb", 2)], "name string, n int")).collect()] == ["a", "bbbbbbb  2"]
