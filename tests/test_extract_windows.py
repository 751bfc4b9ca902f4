"""No distance between the parts of a declaration, and no depth of comments, changes what a scanner finds."""

import pytest

from codeloom.extract import scanner

GAPS = (0, 10, 1_000, 100_000)
DECORATED = {
    "TypeScript": ("@Controller('/a')", "export class A {\n  @Get('/b')\n  list() { return 1; }\n}\n", "//"),
    "Rust": ("#[derive(Debug, Serialize)]", "pub struct A {\n  pub x: Option<i32>,\n}\n", "//"),
    "Java": ("@Service", "public class A {\n  int x;\n}\n", "//"),
    "Kotlin": ("@Service", "class A(val x: Int) {\n  fun f(): Int = 1\n}\n", "//"),
    "CSharp": ("[Table(\"t\")]", "public class A {\n  public int X { get; set; }\n}\n", "//"),
    "Swift": ("@objc(A)", "class AService: Codable {\n  let x: Int?\n}\n", "//"),
    "PHP": ("<?php\n#[Entity(1)]", "class A {\n  public function m() { return 1; }\n}\n", "//"),
    "Cpp": ("template <typename T, class U>", "class A {\npublic:\n  virtual int m() = 0;\n};\n", "//"),
    "Scala": ("@deprecated(\"x\")", "class A extends B {\n  def m(a: Int): Int = a\n}\n", "//"),
    "Go": ("package p\n", "type A struct {\n\tX int `json:\"x\"`\n}\n", "//"),
    "Python": ("import os", "@dataclass\nclass A:\n    x: int = 0\n", "#"),
    "Ruby": ("require 'a'", "class A < B\n  def m(a)\n    a\n  end\nend\n", "#"),
}


def _plain(value):
    """A record without its places."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if k != "span"}
    return [_plain(x) for x in value] if isinstance(value, list) else value


@pytest.mark.parametrize("language", DECORATED)
def test_gap_between_decoration_and_declaration(language):
    mark, body, comment = DECORATED[language]
    scans = [_plain(scanner.scan(f"{mark}\n{comment} {'x' * gap}\n{body}".encode(), language, "a")) for gap in GAPS]
    assert any(scans[0].values())
    assert all(x == scans[0] for x in scans)
    many = "\n".join(f"{comment} line {i}" for i in range(3_000))
    assert _plain(scanner.scan(f"{mark}\n{many}\n{body}".encode(), language, "a")) == scans[0]


def test_services_and_schemas_behind_long_comments():
    assert scanner.scan(b"@Controller()\n/* " + b"a " * 50_000 + b"*/ export class S {}", "TypeScript", "a")["services"]
    assert scanner.scan(b"#[derive(Serialize)]\n" + b"/// doc\n" * 20_000 + b"struct S { a: u8 }", "Rust", "a")["schemas"]
    assert scanner.scan(b"@RestController\n/** " + b"a " * 50_000 + b"*/ class S {}", "Java", "a")["services"]


@pytest.mark.parametrize("n", [1, 20, 5_000])
def test_arrow_functions_with_long_return_types(n):
    kind = " | ".join(f"Kind{i}" for i in range(n))
    found = scanner.scan(f"export const f = (a: string): {kind} => {{ return 1; }};\nconst g = async (a): Promise<{{ a: {kind}; b: number }}> => a;\nconst h = <T extends (x: number) => void>(x: T) => x;\n".encode(), "TypeScript", "a")
    assert [(x["name"], x["visibility"]) for x in found["functions"]] == [("f", "public"), ("g", "private"), ("h", "private")]
    assert found["functions"][0]["return_type"] == kind


def test_functions_whose_type_parameters_hold_functions():
    found = scanner.scan(b"fn apply<F: Fn(i32) -> Vec<Option<u8>>>(f: F) -> u8 { 1 }\nfn it() -> impl Iterator<Item = u8> { x }\nimpl<F: Fn(A) -> Vec<Vec<Vec<B>>>> Run for Job<F> {\n  fn go(&self) {}\n}\n", "Rust", "a")
    assert [x["name"] for x in found["functions"]] == ["apply", "it"]
    assert [(x["trait_name"], x["target"]) for x in found["implementations"]] == [("Run", "Job<F>")]


@pytest.mark.parametrize("language", ["Rust", "Kotlin", "Scala", "Swift"])
def test_nested_comments(language):
    deep = "/* class Hidden { " * 10 + " */" * 10
    body = {"Rust": "struct A { x: u8 }", "Kotlin": "class A", "Scala": "class A {}", "Swift": "class A {}"}[language]
    assert [x["name"] for x in scanner.scan(f"{deep}\n{body}\n".encode(), language, "a")["classes"]] == ["A"]


def test_alias_over_lines_with_comments():
    text = b"export type A =\n  // first\n  | 'x'\n\n  // second\n  | { a: string; b: 'y' };\ntype B = string\nconst c = 1\n"
    found = scanner.scan(text, "TypeScript", "a")["type_aliases"]
    assert [x["name"] for x in found] == ["A", "B"]
    assert found[0]["target"].endswith("b: 'y' }") and found[1]["target"] == "string"


def test_many_declarations_take_linear_time():
    import time

    def took(n):
        text = "".join(f"export type T{i} = {{ a: string }}\nexport interface I{i} {{ m(a: string): void }}\nexport const f{i} = (a: T{i}): I{i} => {{ return a; }}\n" for i in range(n)).encode()
        began = time.process_time()
        assert len(scanner.scan(text, "TypeScript", "a")["functions"]) == n
        return time.process_time() - began

    took(100)
    assert took(4_000) < 40 * max(took(400), 0.01)


def test_modifiers_are_no_part_of_types():
    java = scanner.scan(b"public class A {\n  private static final int x = 1;\n  protected synchronized List<String> m(int a) { return null; }\n  @Override public A() {}\n}\n", "Java", "a")["classes"][0]
    assert [(p["name"], p["type_annotation"], p["visibility"], p["is_readonly"]) for p in java["properties"]] == [("x", "int", "private", True)]
    assert [(m["name"], m["return_type"], m["visibility"]) for m in java["methods"]][0] == ("m", "List<String>", "protected")
    cs = scanner.scan(b"class A {\n  public static async Task<int> M(string a) { }\n  internal readonly string X;\n}\n", "CSharp", "a")["classes"][0]
    assert [(m["return_type"], m["visibility"], m["is_async"], m["is_static"]) for m in cs["methods"]] == [("Task<int>", "public", True, True)]
    assert [(p["type_annotation"], p["visibility"]) for p in cs["properties"]] == [("string", "internal")]
