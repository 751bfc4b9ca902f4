"""Distance, depth and number never change a verdict of the syntax check."""

import time

import pytest

from codeloom.llm import syntax as S


def fault(text, language, path="a"):
    return S.fault(text.encode(), language, path)


@pytest.mark.parametrize("language", ["Rust", "Kotlin", "Swift", "Scala"])
@pytest.mark.parametrize("depth", [1, 4, 10, 2_000])
def test_comments_within_comments(language, depth):
    body = {"Rust": "fn a() {}", "Kotlin": "fun a() {}", "Swift": "func a() {}", "Scala": "class A {}"}[language]
    comment = "/* { " * depth + "*/" * depth
    assert fault(f"{comment}\n{body}\n", language) == ""
    assert fault(f"{comment[:-2]}\n{body}\n", language) == "unterminated"


def filled(language, depth):
    left, right, inner = {"Kotlin": ('"a ${ f(', ') } b"', "{ 1 }"), "Scala": ('s"a ${ f(', ') } b"', "x"), "Swift": ('"a \\( f(', ') ) b"', "[1]"), "CSharp": ('$"a {{ { f(', ') } b"', "x"), "Ruby": ('"a #{ f(', ') } b"', "{}")}[language]
    return left * depth + inner + right * depth


FORM = {"Kotlin": "fun a(): String {{\n  return {}\n}}\n", "Scala": "class A {{\n  def a = {}\n}}\n", "Swift": "func a() -> String {{\n  return {}\n}}\n", "CSharp": "class A {{\n  string F() {{ return {}; }}\n}}\n", "Ruby": "def a\n  {}\nend\n"}


@pytest.mark.parametrize("language", FORM)
@pytest.mark.parametrize("depth", [0, 1, 3, 10, 500])
def test_literals_within_literals(language, depth):
    text = filled(language, depth) if depth else '""'
    assert fault(FORM[language].format(text), language) == ""
    if depth:
        assert fault(FORM[language].format(text[:-1]), language) != ""
        assert fault(FORM[language].format(text.replace("} b", " b", 1).replace(") b", " b", 1)), language) != ""


@pytest.mark.parametrize("n", [0, 3, 30, 5_000])
def test_ruby_method_of_one_line(n):
    arguments = ", ".join(f"argument_{i}" for i in range(n))
    assert fault(f"def f({arguments}) = 1\n", "Ruby") == ""
    assert fault(f"def f({arguments})\n", "Ruby") == "premature_end"


@pytest.mark.parametrize("gap", [1, 10, 1_000, 100_000])
def test_distance(gap):
    blank = " " * gap
    assert fault(f"const a ={blank}/[\"']/;\n", "TypeScript", "a.ts") == ""
    assert fault(f"class A(val x: Int = 1,{blank}val y: Int = 2) {{\n  fun f() {{}}\n}}\n", "Kotlin") == ""
    names = ", ".join(f"val name{i}: Int = {i}" for i in range(gap // 10 + 1))
    assert fault(f"class A({names}) {{\n  fun f() {{}}\n  nonsense nonsense\n}}\n", "Kotlin") == "foreign"
    assert fault(f"import{blank}\n", "TypeScript", "a.ts") == "premature_end"


def test_depth_takes_linear_time():
    def took(depth):
        text = "package p\nfunc a() {\n" + "if x {\n" * depth + "}\n" * depth + "}\n"
        began = time.process_time()
        assert fault(text, "Go") == ""
        return time.process_time() - began

    took(100)
    assert took(40_000) < 40 * max(took(4_000), 0.005)


def test_python_parser_is_told_apart():
    assert fault("x = 1 1\n", "Python") == "python_parser"
    assert fault("x = (1\n", "Python") == "premature_end"
