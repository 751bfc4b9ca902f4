"""Queries of scanning and of what follows from it, over source texts made from table rows, so that SQL knows what has to come out.

Each supplier gives one TypeScript file with an interface of s_suppkey % 13 methods and a class that implements it (less the
last method where the key is odd), one with a service and a schema, and one small file in each other language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.extract import scanner
from codeloom.operators import bootstrap, cache, query, resolve, sinks, tables, validate, work
from codeloom.runtime import read, stored, text

METHODS = 13
KINDS = ("Controller", "Injectable", "Resolver", "Middleware", "Processor")
KIND_OF = {"Controller": "http_controller", "Injectable": "microservice", "Resolver": "graphql_resolver", "Middleware": "middleware", "Processor": "worker"}
#: language -> (extension, text with K for the key, entities as (kind, name, line))
SMALL = {
    "Python": ("py", "import os\n\nclass AK(Protocol):\n    def m(self) -> int: ...\n\nclass BK(BaseModel):\n    x: int = 0\n    def run(self, a: str) -> int:\n        return 1\n\ndef fK(a):\n    return a\n", [("interface", "AK", 2), ("class", "BK", 5), ("schema", "BK", 5), ("function", "fK", 10)]),
    "Rust": ("rs", "use std::fmt::Display;\n\npub trait AK {\n    fn m(&self) -> i32;\n}\n#[derive(Debug, Serialize)]\npub struct BK {\n    pub x: Option<i32>,\n}\nimpl AK for BK {\n    fn m(&self) -> i32 { 1 }\n}\nfn fK() {}\ntype TK = Vec<i32>;\n", [("interface", "AK", 2), ("class", "BK", 6), ("schema", "BK", 6), ("impl", "AK for BK", 9), ("function", "fK", 12), ("type_alias", "TK", 13)]),
    "Go": ("go", "package p\n\nimport \"fmt\"\n\ntype AK interface {\n\tM(a, b int) error\n}\n\ntype BK struct {\n\tX int `json:\"x\"`\n}\n\nfunc (b *BK) M(a, c int) error { return nil }\n\nfunc fK() {}\n", [("interface", "AK", 4), ("class", "BK", 8), ("schema", "BK", 8), ("impl", "BK", 12), ("function", "fK", 14)]),
    "Java": ("java", "package p;\nimport java.util.List;\n\npublic interface AK {\n    int m(String a);\n}\n\n@Service\npublic class BK implements AK {\n    private int x;\n    public int m(String a) { return 1; }\n}\n\nrecord RK(int a, String b) {}\n", [("interface", "AK", 3), ("class", "BK", 8), ("service", "BK", 8), ("class", "RK", 13), ("schema", "RK", 13)]),
    "Kotlin": ("kt", "package p\nimport a.b.C\n\ninterface AK {\n    fun m(a: String): Int\n}\n\ndata class BK(val x: Int, val y: String?)\n\nfun fK(a: Int): Int = a\n", [("interface", "AK", 3), ("class", "BK", 7), ("schema", "BK", 7), ("function", "fK", 9)]),
    "Scala": ("scala", "package p\nimport a.{B, C => D}\n\ntrait AK {\n  def m(a: Int): Int\n}\n\nclass BK extends AK {\n  def m(a: Int): Int = a\n}\n\nobject OK {\n}\n", [("interface", "AK", 3), ("class", "BK", 7), ("class", "OK", 11)]),
    "CSharp": ("cs", "using System;\nnamespace P;\n\npublic interface AK {\n    int M(string a);\n}\n\n[Table(\"t\")]\npublic class BK : AK {\n    [Key]\n    public int X { get; set; }\n    public int M(string a) { return 1; }\n}\n", [("interface", "AK", 3), ("class", "BK", 8), ("schema", "BK", 8)]),
    "Swift": ("swift", "import Foundation\n\nprotocol AK {\n    func m(a: Int) -> Int\n}\n\nstruct BKService: Codable {\n    let x: Int?\n}\n\nextension BKService: AK {\n    func m(a: Int) -> Int { return a }\n}\n\nfunc fK() -> Int { return 1 }\n", [("interface", "AK", 2), ("class", "BKService", 6), ("service", "BKService", 6), ("schema", "BKService", 6), ("impl", "AK for BKService", 10), ("function", "fK", 14)]),
    "Cpp": ("cpp", "#include <vector>\n\nclass AK {\npublic:\n    virtual int m(int a) = 0;\n};\n\nstruct BK {\n    int x;\n    double y;\n};\n\nint fK(int a) {\n    return a;\n}\n", [("interface", "AK", 2), ("class", "AK", 2), ("class", "BK", 7), ("schema", "BK", 7), ("function", "fK", 12)]),
    "PHP": ("php", "<?php\nnamespace P;\nuse A\\B;\n\ninterface AK {\n    public function m(int $a): int;\n}\n\ntrait TK {\n}\n\nclass BK implements AK {\n    private int $x = 0;\n    public function m(int $a): int { return 1; }\n}\n\nfunction fK($a) { return $a; }\n", [("interface", "AK", 4), ("interface", "TK", 8), ("class", "BK", 11), ("function", "fK", 16)]),
    "Ruby": ("rb", "require 'set'\n\nmodule AK\n  def m(a)\n    a\n  end\nend\n\nclass BK < Base\n  def self.run(a, b = 1)\n    a if b\n  end\nend\n", [("interface", "AK", 2), ("class", "BK", 8)]),
}


_LAST = "regexp_replace(m, '\\.[^.]+$', '')"
_JS_IMPORT = r"import\b[^;\"'']*?[\"'']([^\"''\n]*)[\"'']"
_CPP_IMPORT = r"(?:#[ \t]*include[ \t]*[<\"]|(?:export\s+)?import\s+)([^>\"\n;]+)[>\";]"
#: Extension -> how an import looks like in SQL, from the start of a line, and what of the match is its source.
IMPORT_LINES = {
    "java": (r"import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", _LAST), "kt": (r"import\s+([\w.]+(?:\.\*)?)(?:\s+as\s+\w+)?[ \t]*;?[ \t]*$", _LAST),
    "scala": (r"import\s+([\w.]+(?:\.(?:\{[^}]*\}|\*))?)[ \t]*;?[ \t]*$", "regexp_replace(m, '\\.(\\{[^}]*\\}|[^.]+)$', '')"), "cs": (r"(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", "m"),
    "swift": (r"(?:@\w+\s+)?import\s+([\w.]+)", "m"), "php": (r"use\s+([\w\\]+)(?:\s+as\s+\w+)?\s*;", "m"), "rs": (r"(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", "CASE WHEN contains(m, '{') THEN rtrim(split_part(m, '{', 1), ':') ELSE regexp_replace(m, '::[^:]*$', '') END"),
    "rb": (r"(?:require_relative|require|include|extend|load)[ \t(]+([^\n#;)]+)", "trim(trim(m), '\"''`')"), "cpp": (_CPP_IMPORT, "m"), "hpp": (_CPP_IMPORT, "m"), "ts": (_JS_IMPORT, "m"), "tsx": (_JS_IMPORT, "m"), "js": (_JS_IMPORT, "m"),
}


_TYPE_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|data|open|case|export|default|declare|partial|readonly|fileprivate|indirect|inner|value|annotation|override|implicit|lazy)\s+)*"
#: (extension, kind) -> how the line looks on which a type is declared, where a pattern can tell.
TYPE_LINES = {
    ("rs", "class"): r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|union)\s+(\w+)", ("rs", "interface"): r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)",
    ("go", "class"): r"^type\s+(\w+)(?:\[[^\]]*\])?\s+struct\s*\{", ("go", "interface"): r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\s*\{",
    ("rb", "class"): r"^[ \t]*class\s+([\w:]+)", ("rb", "interface"): r"^[ \t]*module\s+([\w:]+)",
    **{(e, k): rf"^[ \t]*{_TYPE_MODS}(?:{w})\s+(\w+)" for e, k, w in (("java", "class", "class|record"), ("java", "interface", "interface"), ("kt", "class", "class|object"), ("kt", "interface", "interface"), ("scala", "class", "class|object"), ("scala", "interface", "trait"), ("php", "class", "class"), ("php", "interface", "interface|trait"), ("cs", "interface", "interface"), ("swift", "interface", "protocol"), ("ts", "interface", "interface"))},
}


def _suppliers(spark: SparkSession, root: str) -> DataFrame:
    nations = read(spark, root, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("dir"))
    return read(spark, root, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nations), "s_nationkey")  # nation is a fixed table of 25 rows


def _repeat(n: Column, line) -> Column:
    """Lines for i from 0 up to n."""
    return F.when(n <= 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), line), ""))


def types_files(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = k % METHODS
    have = n - F.when((k % 2 == 1) & (n > 0), 1).otherwise(0)
    body = F.concat(
        F.lit('import { IS'), text(k % 10 + 1), F.lit(' } from "./s'), text(k % 10 + 1), F.lit('";\n'),
        F.lit("export interface IS"), text(k), F.lit(" {\n"), _repeat(n, lambda i: F.concat(F.lit("  m"), text(i), F.lit("(a: string): number;\n"))), F.lit("}\n"),
        F.lit("export class CS"), text(k), F.lit(" implements IS"), text(k), F.lit(" {\n"), _repeat(have, lambda i: F.concat(F.lit("  m"), text(i), F.lit("(a: string): number { return 1; }\n"))), F.lit("}\n"),
    )
    path = F.concat(F.lit("src/"), F.col("dir"), F.lit("/s"), text(k), F.lit(".ts"))
    return _suppliers(spark, root).select(path.alias("path"), F.lit("TypeScript").alias("language"), F.encode(body, "utf-8").alias("content"))


def service_files(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 5 + 1).cast("int"))
    body = F.concat(
        F.lit("@"), kind, F.lit('("/p'), text(k), F.lit('")\nexport class Svc'), text(k), F.lit(" {\n  constructor(private readonly dep: Dep"), text(k % 7), F.lit(') {}\n  @Get("/g'), text(k),
        F.lit('")\n  list() { return 1; }\n  @Post("/c")\n  make(a: string) { return a; }\n}\nexport const T'), text(k), F.lit(' = pgTable("t_'), text(k),
        F.lit('", {\n  id: serial("id").primaryKey(),\n  f'), text(k % 3), F.lit(': text("f").nullable().unique(),\n});\n'),
    )
    path = F.concat(F.lit("src/"), F.col("dir"), F.lit("/svc"), text(k), F.lit(".ts"))
    return _suppliers(spark, root).select(path.alias("path"), F.lit("TypeScript").alias("language"), F.encode(body, "utf-8").alias("content"))


def small_files(spark: SparkSession, root: str) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(x).alias("language"), F.lit(e).alias("ext"), F.lit(t).alias("body")) for x, (e, t, _) in SMALL.items()])
    rows = _suppliers(spark, root).select("s_suppkey", F.inline(forms))
    return rows.select(F.concat(F.lit("small/k"), text("s_suppkey"), F.lit("."), F.col("ext")).alias("path"), "language", F.encode(F.regexp_replace("body", "(?<![A-Z])([ABRTOf])K", F.concat(F.lit("$1"), text("s_suppkey"))), "utf-8").alias("content"))


#: What the members of the small files are: (extension, owner, name, line, visibility, static, parameters, return type) of methods,
#: (extension, interface, method, has a default), (extension, schema, framework, field, type, optional, key), (extension, source, symbols, wildcard).
MEMBERS = [
    ("py", "BK", "run", 7, "unknown", False, 1, "int"), ("rs", "BK", "m", 10, "private", False, 1, "i32"), ("go", "BK", "M", 12, "public", False, 2, "error"), ("java", "BK", "m", 10, "public", False, 1, "int"),
    ("scala", "BK", "m", 8, "public", False, 1, "Int"), ("cs", "BK", "M", 11, "public", False, 1, "int"), ("swift", "BKService", "m", 11, "internal", False, 1, "Int"), ("cpp", "AK", "m", 4, "public", False, 1, "int"),
    ("php", "BK", "m", 13, "public", False, 1, "int"), ("rb", "BK", "run", 9, "public", True, 2, None),
]
SIGNATURES = [(e, "AK", "M" if e in ("go", "cs") else "m", e == "rb") for e in ("rs", "go", "java", "kt", "scala", "cs", "swift", "cpp", "php", "rb")]
FIELDS = [
    ("py", "BK", "pydantic", "x", None, False, False), ("rs", "BK", "serde", "x", "Option<i32>", True, False), ("go", "BK", "go-tags", "X", "int", False, False), ("java", "RK", "java-record", "a", "int", False, False),
    ("java", "RK", "java-record", "b", "String", False, False), ("kt", "BK", "kotlin-data-class", "x", "Int", False, False), ("kt", "BK", "kotlin-data-class", "y", "String?", True, False),
    ("cs", "BK", "ef-core", "X", "int", False, True), ("swift", "BKService", "codable", "x", "Int?", True, False), ("cpp", "BK", "cpp-struct", "x", "int", False, False), ("cpp", "BK", "cpp-struct", "y", "double", False, False),
]
IMPORTED = [
    ("py", "os", "", False), ("rs", "std::fmt", "Display", False), ("go", "fmt", "fmt", False), ("java", "java.util", "List", False), ("kt", "a.b", "C", False), ("scala", "a", "B,C as D", False),
    ("cs", "System", "", True), ("swift", "Foundation", "", True), ("cpp", "vector", "", True), ("php", "A\\B", "B", False), ("rb", "set", "", False),
]


def barrel_files(spark: SparkSession, root: str) -> DataFrame:
    """One file per directory that exports the interfaces of its files again."""
    line = F.concat(F.lit("export { IS"), text("s_suppkey"), F.lit(' } from "./s'), text("s_suppkey"), F.lit('";\n'))
    rows = _suppliers(spark, root).groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("body"))
    return rows.select(F.concat(F.lit("src/"), F.col("dir"), F.lit("/index.ts")).alias("path"), F.lit("TypeScript").alias("language"), F.encode("body", "utf-8").alias("content"))


#: A file that breaks eight of the rules, and one that breaks the ninth, with K for the key.
BAD = "export interface bad_K {\n  run_K(a: string): void;\n}\ninterface DupK {\n  a(): void;\n  a(): void;\n}\ninterface DupK {\n  b(): void;\n}\n@Controller(\"/x\")\nexport class EmptyK {\n}\n@Injectable()\nexport class GodK {\n" + "".join(f"  m{i}() {{ return 1; }}\n" for i in range(16)) + "}\nexport interface None_K {\n}\n"
BAD_PY = "@dataclass\nclass DK:\n    x: int = 0\n"
#: (file, rule, severity, message, entity, line) of what they break.
BROKEN = [
    ("ts", "interfaces-pascal-case", "warn", "Interface 'bad_K' is not PascalCase", "bad_K", 0), ("ts", "interfaces-pascal-case", "warn", "Interface 'None_K' is not PascalCase", "None_K", 32),
    ("ts", "methods-naming-convention", "warn", "Method 'run_K' in interface 'bad_K' doesn't follow camelCase naming convention", "run_K", 1),
    ("ts", "no-duplicate-interface-names", "fail", "Duplicate interface name 'DupK' in same file", "DupK", 7), ("ts", "no-duplicate-method-names", "fail", "Duplicate method 'a' in interface 'DupK'", "a", 5),
    ("ts", "interfaces-have-methods", "warn", "Interface 'None_K' has no methods or properties", "None_K", 32), ("ts", "services-have-methods", "warn", "Service 'EmptyK' has no methods or routes", "EmptyK", 11),
    ("ts", "no-god-services", "warn", "Service 'GodK' has 16 methods (max 15)", "GodK", 14), ("ts", "interfaces-have-implementors", "fail", "Public interface 'bad_K' has no implementors", "bad_K", 0),
    ("ts", "interfaces-have-implementors", "fail", "Public interface 'None_K' has no implementors", "None_K", 32), ("py", "schema-fields-have-types", "warn", "Field 'x' in schema 'DK' has no type annotation", "DK", 1),
]


def broken_files(spark: SparkSession, root: str) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(x).alias("language"), F.lit(e).alias("ext"), F.lit(t).alias("body")) for x, e, t in (("TypeScript", "ts", BAD), ("Python", "py", BAD_PY))])
    rows = _suppliers(spark, root).select("s_suppkey", F.inline(forms))
    body = F.regexp_replace("body", "(?<=bad_|run_|None_|Dup|Empty|God|D)K", text("s_suppkey"))
    return rows.select(F.concat(F.lit("bad/k"), text("s_suppkey"), F.lit("."), F.col("ext")).alias("path"), "language", F.encode(body, "utf-8").alias("content"))


def _types(spark: SparkSession, root: str) -> DataFrame:
    return stored(scanner.ir_files(types_files(spark, root)))


def scan_types_entities(spark: SparkSession, root: str) -> DataFrame:
    return tables.entities(_types(spark, root)).select("name", "kind", "file", "line", "language", "build_status", "confidence", "visibility")


def scan_types_stats(spark: SparkSession, root: str) -> DataFrame:
    return tables.stats(_types(spark, root))


def scan_types_methods(spark: SparkSession, root: str) -> DataFrame:
    return tables.methods(_types(spark, root)).select("owner_kind", "owner_name", "file", "name", "line", "return_type", "n_parameters", "method_ord")


def scan_methods_by_owner(spark: SparkSession, root: str) -> DataFrame:
    return query.methods_by_owner(tables.methods(_types(spark, root)), "CS12").select("name", "file")


def scan_small_entities(spark: SparkSession, root: str) -> DataFrame:
    return tables.entities(stored(scanner.ir_files(small_files(spark, root)))).select("language", "kind", "name", "file", "line")


def scan_small_members(spark: SparkSession, root: str) -> DataFrame:
    rows = tables.methods(stored(scanner.ir_files(small_files(spark, root)))).where("owner_kind <> 'service'")
    return rows.select("file", "owner_name", "name", "line", "visibility", "is_static", "n_parameters", "return_type")


def scan_small_signatures(spark: SparkSession, root: str) -> DataFrame:
    return tables.interface_methods(scanner.ir_files(small_files(spark, root))).select("file", "interface", "name", "has_default")


def scan_small_fields(spark: SparkSession, root: str) -> DataFrame:
    return tables.fields(scanner.ir_files(small_files(spark, root))).select("file", "schema", "source_framework", "name", "type_annotation", "is_optional", "is_primary_key")


def scan_small_imports(spark: SparkSession, root: str) -> DataFrame:
    named = F.transform("symbols", lambda x: F.concat_ws(" as ", x.getField("name"), x.getField("alias")))
    return tables.imports(scanner.ir_files(small_files(spark, root))).select("file", "source", F.array_join(named, ",").alias("symbols"), "is_wildcard")


def scan_services(spark: SparkSession, root: str) -> DataFrame:
    ir = scanner.ir_files(service_files(spark, root))
    rows = ir.select("path", F.explode("services").alias("s")).select("path", "s.*")
    return rows.select("name", F.col("path").alias("file"), "kind", F.array_join("dependencies", ",").alias("dependencies"), F.size("methods").alias("n_methods"))


def scan_routes(spark: SparkSession, root: str) -> DataFrame:
    return tables.routes(scanner.ir_files(service_files(spark, root))).select("service", "file", "method", "path", "handler", "route_ord")


def scan_schema_fields(spark: SparkSession, root: str) -> DataFrame:
    ir = scanner.ir_files(service_files(spark, root))
    return tables.fields(ir).select("schema", "file", "source_framework", "name", "type_annotation", "is_optional", "is_primary_key", F.array_join("constraints", ",").alias("constraints"), "field_ord")


def imports_resolved(spark: SparkSession, root: str) -> DataFrame:
    ir = _types(spark, root)
    return resolve.resolve_imports(tables.imports(ir), resolve.path_index(ir)).select("file", "source", "resolved_path", F.array_join("symbols", ",").alias("symbols"))


def exports_by_symbol(spark: SparkSession, root: str) -> DataFrame:
    return resolve.files_by_export(tables.exports(_types(spark, root))).select("name", F.array_join("files", ",").alias("files"))


def implementors_map(spark: SparkSession, root: str) -> DataFrame:
    return query.implementors(tables.implements(_types(spark, root))).select("interface_name", F.array_join("implementors", ",").alias("implementors"))


def implementation_links(spark: SparkSession, root: str) -> DataFrame:
    ir = _types(spark, root)
    names = tables.entities(ir).where("kind = 'interface'").select("name", "file")
    return resolve.implementation_links(tables.implements(ir), names).select("interface_name", "implementor", "impl_file", "interface_file")


def impl_completeness(spark: SparkSession, root: str) -> DataFrame:
    ir = _types(spark, root)
    return resolve.missing_methods(tables.implements(ir), tables.interface_methods(ir), tables.methods(ir)).select("interface_name", "implementor", "impl_file", F.array_join("missing", ",").alias("missing"))


def rule_violations(spark: SparkSession, root: str) -> DataFrame:
    return validate.violations(_types(spark, root))


def rule_violations_broken(spark: SparkSession, root: str) -> DataFrame:
    """Over files that break every rule but the one on interfaces with too many methods, which rule_violations shows."""
    return validate.violations(stored(scanner.ir_files(broken_files(spark, root))))


def validation_summary_broken(spark: SparkSession, root: str) -> DataFrame:
    return validate.summary(rule_violations_broken(spark, root), len(validate.RULES))


def exports_resolved(spark: SparkSession, root: str) -> DataFrame:
    ir = stored(scanner.ir_files(types_files(spark, root).unionByName(barrel_files(spark, root))))
    return _exports(ir).select("file", "name", "origin_file", "via_file")


def _exports(ir: DataFrame) -> DataFrame:
    exports = tables.exports(ir)
    return resolve.resolve_exports(exports, resolve.resolve_imports(resolve.export_sources(exports), resolve.path_index(ir)))


def services_with_routes(spark: SparkSession, root: str) -> DataFrame:
    rows = query.service_table(scanner.ir_files(service_files(spark, root)), "http_controller", show_routes=True, show_dependencies=True)
    return rows.select("name", "file", "n_methods", F.array_join("routes", ",").alias("routes"), F.array_join("dependencies", ",").alias("dependencies"))


def interfaces_with_methods(spark: SparkSession, root: str) -> DataFrame:
    return query.interfaces(_types(spark, root), "IS1", show_methods=True).select("name", "file", "visibility", "n_methods", F.array_join("methods", ",").alias("methods"))


def implementations_with_methods(spark: SparkSession, root: str) -> DataFrame:
    rows = query.impl_table(scanner.ir_files(small_files(spark, root)), show_methods=True)
    return rows.select("target", "trait_name", "file", F.array_join("methods", ",").alias("methods"))


def partition_hybrid(spark: SparkSession, root: str) -> DataFrame:
    """Files of one top directory: the last agent has it, the others their concerns."""
    ir = stored(scanner.ir_files(types_files(spark, root).unionByName(service_files(spark, root))))
    return work.hybrid(ir).groupBy("agent", "concern").agg(F.count("*").alias("n_files"))


def validation_summary(spark: SparkSession, root: str) -> DataFrame:
    return validate.summary(validate.violations(_types(spark, root)), len(validate.RULES))


def partition_concern(spark: SparkSession, root: str) -> DataFrame:
    ir = scanner.ir_files(types_files(spark, root).unionByName(service_files(spark, root)))
    return work.by_concern(ir).groupBy("agent", "concern").agg(F.count("*").alias("n_files"))


def focus_filter(spark: SparkSession, root: str) -> DataFrame:
    return work.focused(_types(spark, root), "cs7").select("path")


def field_mask(spark: SparkSession, root: str) -> DataFrame:
    masked = sinks.apply_mask(_types(spark, root), "path,interfaces.name,interfaces.methods.name")
    return masked.select("path", F.expr("transform(interfaces, i -> i.name)").getItem(0).alias("interface"), F.array_join(F.expr("transform(interfaces[0].methods, m -> m.name)"), ",").alias("methods"))


def children_listing(spark: SparkSession, root: str) -> DataFrame:
    return tables.children(_types(spark, root)).groupBy("kind", "child_kind").agg(F.count("*").alias("n"))


def _walked(spark: SparkSession, root: str) -> DataFrame:
    files = read(spark, root, "walked_files").select(F.concat_ws("/", "repo", "path").alias("path"), "language", "content", "content_hash")
    return scanner.ir_files(files)


def scan_walked_entities(spark: SparkSession, root: str) -> DataFrame:
    return tables.entities(stored(_walked(spark, root)))


def scan_walked_stats(spark: SparkSession, root: str) -> DataFrame:
    return tables.stats(_walked(spark, root))


def _walked_imports(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    ir = stored(_walked(spark, root))
    return ir, resolve.resolve_imports(tables.imports(ir), resolve.path_index(ir))


def walked_imports(spark: SparkSession, root: str) -> DataFrame:
    """Imports of every real source file in the languages in which a pattern can tell an import."""
    rows = tables.imports(_walked(spark, root))
    return rows.where(F.substring_index("file", ".", -1).isin(*IMPORT_LINES)).groupBy("file", "source").agg(F.count("*").alias("n"))


def walked_types(spark: SparkSession, root: str) -> DataFrame:
    """Types of every real source file, of the kinds in which a pattern can tell them."""
    known = F.concat_ws(" ", F.substring_index("file", ".", -1), "kind").isin(*[" ".join(x) for x in TYPE_LINES])
    return tables.entities(stored(_walked(spark, root))).where(known).groupBy("file", "kind", "name").agg(F.count("*").alias("n"))


def walked_imports_resolved(spark: SparkSession, root: str) -> DataFrame:
    return _walked_imports(spark, root)[1].select("file", "source", "resolved_path", F.array_join("symbols", ",").alias("symbols"), "import_ord")


def walked_exports_resolved(spark: SparkSession, root: str) -> DataFrame:
    return _exports(stored(_walked(spark, root)))


def walked_connections(spark: SparkSession, root: str) -> DataFrame:
    """Connections between the directories of one repository tree, inferred from the imports of its files."""
    ir = stored(_walked(spark, root))
    files = ir.select("path")
    subs = bootstrap.subsystems(files, 3)
    return bootstrap.connections(files, tables.imports(ir).select("file", "source"), subs)


def walked_rule_violations(spark: SparkSession, root: str) -> DataFrame:
    return validate.violations(stored(_walked(spark, root)))


def walked_routes(spark: SparkSession, root: str) -> DataFrame:
    return tables.routes(_walked(spark, root))


def walked_schema_fields(spark: SparkSession, root: str) -> DataFrame:
    return tables.fields(_walked(spark, root)).withColumn("constraints", F.array_join("constraints", ","))


def walked_async_methods(spark: SparkSession, root: str) -> DataFrame:
    return query.method_filter(tables.methods(stored(_walked(spark, root))), is_async=True).select("owner_kind", "owner_name", "file", "name", "line", "visibility")


def walked_completeness(spark: SparkSession, root: str) -> DataFrame:
    ir = stored(_walked(spark, root))
    return resolve.missing_methods(tables.implements(ir), tables.interface_methods(ir), tables.methods(ir)).withColumn("missing", F.array_join("missing", ","))


def walked_links(spark: SparkSession, root: str) -> DataFrame:
    ir, imports = _walked_imports(spark, root)
    return resolve.implementation_links(tables.implements(ir), tables.entities(ir).where("kind = 'interface'").select("name", "file"), imports).select("interface_name", "implementor", "impl_file", "interface_file")


def walked_partition_concern(spark: SparkSession, root: str) -> DataFrame:
    return work.by_concern(_walked(spark, root)).groupBy("agent", "concern").agg(F.count("*").alias("n_files"))


def walked_partition_hybrid(spark: SparkSession, root: str) -> DataFrame:
    return work.hybrid(stored(_walked(spark, root))).groupBy("agent", "concern").agg(F.count("*").alias("n_files"))


def partition_by_directory(spark: SparkSession, root: str) -> DataFrame:
    files = read(spark, root, "walked_files").select(F.concat_ws("/", "repo", "path").alias("path"), F.lit("built").alias("build_status"))
    return work.by_directory(files).select("agent", "directory", "path")


def cache_rescan(spark: SparkSession, root: str) -> DataFrame:
    """Totals of a second scan: records of known content come from the store, only the others are scanned."""
    files = read(spark, root, "walked_files").select(F.concat_ws("/", "repo", "path").alias("path"), "language", "content", F.sha2("content", 256).alias("content_hash"))
    store = stored(scanner.ir_files(files))
    return tables.stats(cache.rescan(files, store, scanner.ir_files))


QUERIES = {
    f.__name__: f
    for f in (
        scan_types_entities, scan_types_stats, scan_types_methods, scan_methods_by_owner, scan_small_entities, scan_small_members, scan_small_signatures, scan_small_fields, scan_small_imports, scan_services, scan_routes, scan_schema_fields, imports_resolved, exports_by_symbol,
        implementors_map, implementation_links, impl_completeness, rule_violations, validation_summary, partition_concern, focus_filter, field_mask, children_listing, scan_walked_entities, scan_walked_stats,
        rule_violations_broken, validation_summary_broken, exports_resolved, services_with_routes, interfaces_with_methods, implementations_with_methods, partition_hybrid, walked_imports, walked_types, walked_imports_resolved,
        walked_exports_resolved, walked_connections, walked_rule_violations, walked_routes, walked_schema_fields, walked_async_methods, walked_completeness, walked_links, walked_partition_concern,
        walked_partition_hybrid, partition_by_directory, cache_rescan,
    )
}

_S = """WITH s AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS t, s_suppkey % 13 AS n, s_suppkey % 13 - CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 13 > 0 THEN 1 ELSE 0 END AS have,
  'src/' || lower(replace(n_name, ' ', '_')) AS dir, 'src/' || lower(replace(n_name, ' ', '_')) || '/s' || CAST(s_suppkey AS VARCHAR) || '.ts' AS file,
  'src/' || lower(replace(n_name, ' ', '_')) || '/svc' || CAST(s_suppkey AS VARCHAR) || '.ts' AS svc
  FROM supplier JOIN nation ON s_nationkey = n_nationkey) """


def _violations_sql() -> str:
    return _S + """
SELECT 'no-god-interfaces' AS rule, 'warn' AS severity, 'Interface ''IS' || t || ''' has ' || CAST(n AS VARCHAR) || ' methods (max 10)' AS message, 'IS' || t AS entity_name, file, CAST(1 AS INTEGER) AS line FROM s WHERE n > 10
UNION ALL SELECT 'interfaces-have-methods', 'warn', 'Interface ''IS' || t || ''' has no methods or properties', 'IS' || t, file, 1 FROM s WHERE n = 0"""


def _broken_sql() -> str:
    rows = ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in BROKEN)
    put = lambda c: f"replace(regexp_replace({c}, '(bad_|run_|None_|Dup|Empty|God|D)K', '\\1~', 'g'), '~', t)"
    return _S + f"SELECT rule, severity, {put('message')} AS message, {put('entity')} AS entity_name, 'bad/k' || t || '.' || ext AS file, CAST(line AS INTEGER) AS line FROM s, (VALUES {rows}) v(ext, rule, severity, message, entity, line)"


def _imports_sql() -> str:
    """Lines of the decoded files; those within block comments or literals would differ, and there are none."""
    parts = []
    for ext, (line, source) in IMPORT_LINES.items():
        parts.append(f"SELECT file, {source} AS source FROM (SELECT repo || '/' || path AS file, unnest(regexp_extract_all(replace(decode(content), chr(13), chr(10)), '(?m)^[ \\t]*{line}', 1)) AS m FROM walked_files WHERE path LIKE '%.{ext}')")
    return "SELECT file, source, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") x GROUP BY 1, 2"


def _types_sql() -> str:
    parts = [f"SELECT file, '{kind}' AS kind, name FROM (SELECT repo || '/' || path AS file, unnest(regexp_extract_all(replace(decode(content), chr(13), chr(10)), '(?m){line}', 1)) AS name FROM walked_files WHERE path LIKE '%.{ext}')" for (ext, kind), line in TYPE_LINES.items()]
    return "SELECT file, kind, name, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") x GROUP BY 1, 2, 3"


def _small_sql(rows: list[tuple], names: str) -> str:
    """Each row for each supplier; the first column is the extension, K in the second the key."""
    shown = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v + "'" if isinstance(v, str) else str(v).lower()
    values = ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)
    first, *others = names.split(", ")
    kept = ", ".join(f"CAST({x} AS INTEGER) AS {x}" if x in ("line", "n_parameters") else x for x in others)
    put = f"replace({first}, 'K', t) AS {first}" if first != "source" else first
    return _S + f"SELECT 'small/k' || t || '.' || ext AS file, {put}, {kept} FROM s, (VALUES {values}) v(ext, {names})"


def _impl_rows() -> str:
    found = [(e, n) for e, (e, _, ents) in ((x, SMALL[x]) for x in SMALL) for k, n, _ in ents if k == "impl"]
    return ", ".join(f"('{e}', '{n}', '{'M' if e == 'go' else 'm'}')" for e, n in found)


SQL = {
    "scan_small_members": _small_sql(MEMBERS, "owner_name, name, line, visibility, is_static, n_parameters, return_type"),
    "scan_small_signatures": _small_sql(SIGNATURES, "interface, name, has_default"),
    "scan_small_fields": _small_sql(FIELDS, "schema, source_framework, name, type_annotation, is_optional, is_primary_key"),
    "scan_small_imports": _small_sql(IMPORTED, "source, symbols, is_wildcard"),
    "walked_imports": _imports_sql(),
    "walked_types": _types_sql(),
    "rule_violations_broken": _broken_sql(),
    "validation_summary_broken": f"SELECT CAST(10 AS BIGINT) AS rules_checked, count(*) FILTER (severity = 'warn') AS warn_count, count(*) FILTER (severity = 'fail') AS fail_count, CAST(8 AS BIGINT) AS pass_count FROM ({_broken_sql()}) v",
    "exports_resolved": _S + """SELECT file, 'IS' || t AS name, file AS origin_file, NULL AS via_file FROM s UNION ALL SELECT file, 'CS' || t, file, NULL FROM s
UNION ALL SELECT dir || '/index.ts', 'IS' || t, file, dir || '/index.ts' FROM s""",
    "services_with_routes": _S + "SELECT 'Svc' || t AS name, svc AS file, CAST(2 AS INTEGER) AS n_methods, 'GET /g' || t || ',POST /c' AS routes, 'Dep' || CAST(k % 7 AS VARCHAR) AS dependencies FROM s WHERE k % 5 = 0",
    "interfaces_with_methods": _S + "SELECT 'IS' || t AS name, file, 'public' AS visibility, CAST(n AS INTEGER) AS n_methods, coalesce(array_to_string(list_transform(range(n), lambda i: 'm' || CAST(i AS VARCHAR)), ','), '') AS methods FROM s WHERE t LIKE '1%'",
    "implementations_with_methods": _S + f"""SELECT replace(CASE WHEN contains(w, ' for ') THEN split_part(w, ' for ', 2) ELSE w END, 'K', t) AS target, CASE WHEN contains(w, ' for ') THEN replace(split_part(w, ' for ', 1), 'K', t) END AS trait_name, 'small/k' || t || '.' || ext AS file, m AS methods
FROM s, (VALUES {_impl_rows()}) v(ext, w, m)""",
    "partition_hybrid": _S + """SELECT CAST(1 AS INTEGER) AS agent, 'interfaces' AS concern, count(*) AS n_files FROM s UNION ALL SELECT 2, 'services', count(*) FROM s UNION ALL SELECT 3, 'methods', 2 * count(*) FROM s UNION ALL SELECT 4, 'decorators', count(*) FROM s
UNION ALL SELECT 5, 'implementations', 2 * count(*) FROM s""",
    "partition_by_directory": "WITH d AS (SELECT directory, CAST((row_number() OVER (ORDER BY n DESC, directory) - 1) % 5 + 1 AS INTEGER) AS agent FROM (SELECT split_part(repo || '/' || path, '/', 1) AS directory, count(*) AS n FROM walked_files GROUP BY 1)) SELECT d.agent, d.directory, w.repo || '/' || w.path AS path FROM walked_files w JOIN d ON d.directory = split_part(w.repo || '/' || w.path, '/', 1)",
    "scan_types_entities": _S + """SELECT 'IS' || t AS name, 'interface' AS kind, file, CAST(1 AS INTEGER) AS line, 'TypeScript' AS language, 'built' AS build_status, 'high' AS confidence, 'public' AS visibility FROM s
UNION ALL SELECT 'CS' || t, 'class', file, CAST(n + 3 AS INTEGER), 'TypeScript', 'built', 'high', 'public' FROM s""",
    "scan_types_stats": _S + """SELECT count(*) AS total_files, count(*) AS total_interfaces, CAST(0 AS BIGINT) AS total_services, count(*) AS total_classes, CAST(0 AS BIGINT) AS total_functions, CAST(0 AS BIGINT) AS total_schemas,
CAST(0 AS BIGINT) AS total_implementations, CAST(0 AS BIGINT) AS total_type_aliases, CAST(sum(have) AS BIGINT) AS total_methods FROM s""",
    "scan_types_methods": _S + """SELECT 'class' AS owner_kind, 'CS' || t AS owner_name, file, 'm' || CAST(i AS VARCHAR) AS name, CAST(n + 4 + i AS INTEGER) AS line, 'number' AS return_type, CAST(1 AS INTEGER) AS n_parameters, CAST(i AS INTEGER) AS method_ord
FROM (SELECT *, unnest(range(have)) AS i FROM s) x""",
    "scan_methods_by_owner": _S + "SELECT 'm' || CAST(i AS VARCHAR) AS name, file FROM (SELECT *, unnest(range(have)) AS i FROM s WHERE k = 12) x",
    "scan_small_entities": _S + "SELECT language, kind, replace(name, 'K', t) AS name, 'small/k' || t || '.' || ext AS file, CAST(line AS INTEGER) AS line FROM s, (VALUES "
    + ", ".join(f"('{x}', '{e}', '{k}', '{n}', {line})" for x, (e, _, found) in SMALL.items() for k, n, line in found) + ") v(language, ext, kind, name, line)",
    "scan_services": _S + "SELECT 'Svc' || t AS name, svc AS file, CASE k % 5 " + " ".join(f"WHEN {i} THEN '{KIND_OF[x]}'" for i, x in enumerate(KINDS)) + " END AS kind, 'Dep' || CAST(k % 7 AS VARCHAR) AS dependencies, CAST(2 AS INTEGER) AS n_methods FROM s",
    "scan_routes": _S + """SELECT 'Svc' || t AS service, svc AS file, 'GET' AS method, '/g' || t AS path, 'list' AS handler, CAST(0 AS INTEGER) AS route_ord FROM s
UNION ALL SELECT 'Svc' || t, svc, 'POST', '/c', 'make', 1 FROM s""",
    "scan_schema_fields": _S + """SELECT 'T' || t AS schema, svc AS file, 'drizzle' AS source_framework, 'id' AS name, 'serial("id").primaryKey()' AS type_annotation, false AS is_optional, true AS is_primary_key, '' AS constraints, CAST(0 AS INTEGER) AS field_ord FROM s
UNION ALL SELECT 'T' || t, svc, 'drizzle', 'f' || CAST(k % 3 AS VARCHAR), 'text("f").nullable().unique()', true, false, 'unique,nullable', 1 FROM s""",
    "imports_resolved": _S + """, m AS (SELECT max(file) AS file, 'IS' || CAST(k AS VARCHAR) AS i, k FROM s GROUP BY k)
SELECT s.file, './s' || CAST(s.k % 10 + 1 AS VARCHAR) AS source, o.file AS resolved_path, 'IS' || CAST(s.k % 10 + 1 AS VARCHAR) AS symbols FROM s LEFT JOIN s o ON o.k = s.k % 10 + 1 AND o.dir = s.dir""",
    "exports_by_symbol": _S + "SELECT 'IS' || t AS name, file AS files FROM s UNION ALL SELECT 'CS' || t, file FROM s",
    "implementors_map": _S + "SELECT 'IS' || t AS interface_name, 'CS' || t AS implementors FROM s",
    "implementation_links": _S + "SELECT 'IS' || t AS interface_name, 'CS' || t AS implementor, file AS impl_file, file AS interface_file FROM s",
    "impl_completeness": _S + "SELECT 'IS' || t AS interface_name, 'CS' || t AS implementor, file AS impl_file, 'm' || CAST(n - 1 AS VARCHAR) AS missing FROM s WHERE have < n",
    "rule_violations": _violations_sql(),
    "validation_summary": f"SELECT CAST(10 AS BIGINT) AS rules_checked, count(*) AS warn_count, CAST(0 AS BIGINT) AS fail_count, CAST(10 - CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS BIGINT) AS pass_count FROM ({_violations_sql()}) v",
    "partition_concern": _S + """SELECT CAST(1 AS INTEGER) AS agent, 'interfaces' AS concern, count(*) AS n_files FROM s UNION ALL SELECT 2, 'services', count(*) FROM s UNION ALL SELECT 3, 'methods', 2 * count(*) FROM s UNION ALL SELECT 4, 'decorators', count(*) FROM s""",
    "focus_filter": _S + "SELECT file AS path FROM s WHERE contains(lower('CS' || t), 'cs7')",
    "field_mask": _S + "SELECT file AS path, 'IS' || t AS interface, coalesce(array_to_string(list_transform(range(n), lambda i: 'm' || CAST(i AS VARCHAR)), ','), '') AS methods FROM s",
    "children_listing": _S + "SELECT 'interface' AS kind, 'method' AS child_kind, CAST(sum(n) AS BIGINT) AS n FROM s UNION ALL SELECT 'class', 'method', CAST(sum(have) AS BIGINT) FROM s",
}
