"""Syntax faults: exact truth from Python's parser, whole and broken files of every language."""

import ast
import random

import pytest

from codeloom.llm import syntax as S

GOOD = {
    "TypeScript": 'import { A } from "./a";\nimport type { B } from "b";\n\n// don\'t close the { twice\nexport class X<T> extends A implements B {\n  private readonly a?: Map<string, number>;\n  async run(v: string = "}"): Promise<void> {\n    const r = /[/"{]+/g.test(v) ? `a ${v + `b ${1}`}` : "x";\n    if (v > 1 && r) { return; }\n  }\n}\nexport default function f() { return a / 2 / 3; }\n',
    "Rust": 'use std::collections::{HashMap, HashSet};\n\n/* outer /* inner { */ */\n#[derive(Debug, Clone)]\npub struct P<\'a> {\n    pub a: &\'a str,\n}\nimpl<\'a> P<\'a> {\n    fn c(&self) -> char { \'{\' }\n    fn s(&self) -> String { r#"un " closed {"#.into() }\n}\nconst N: [u8; 2] = [1, 2];\n',
    "Go": 'package p\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype T struct {\n\tA, b int `json:"a"`\n}\n\nfunc (t *T) Run(a, b int) (int, error) {\n\ts := `raw { "`\n\tr := \'{\'\n\treturn len(s) + int(r), nil\n}\n\nvar x = []int{1, 2}\n',
    "Java": 'package a.b;\nimport java.util.*;\nimport static a.B.c;\n\n@Service\npublic final class X<T extends Y> extends Z implements A<T>, B {\n    private char c = \'"\';\n    private String s = """\n        text " { "\n        """;\n    public <U> U m(int... a) throws E { return null; }\n}\n\ninterface I {}\nrecord R(int a, String b) implements I {}\n',
    "Kotlin": 'package a.b\n\nimport c.d.*\nimport e.F as G\n\ndata class P(val a: Int, val b: String? = null) : Q(), R {\n    private val s: String = "v ${a + "x".length} {"\n    override fun m(x: Int): Int =\n        x + 1\n    companion object {\n        const val N = 1\n    }\n}\n\nfun <T> f(x: T): Unit where T : Any {}\n',
    "Scala": 'package a.b\n\nimport c.{D, E => F}\nimport g._\n\ncase class P(a: Int)(implicit b: String) extends Q with R {\n  val s = s"""text ${a} " {"""\n  def m[T](x: T): Int = x match {\n    case _ => \'{\'.toInt\n  }\n}\n\nobject O\n\ntrait T { def x: Int }\n',
    "CSharp": 'using System;\nusing F = A.B;\n\nnamespace N;\n\n#region r\n[Serializable]\npublic sealed class X<T> : Y<T>, IZ where T : class {\n    public string P { get; set; } = @"a""b{";\n    public int M(int a = 1) => $"v {a + "x".Length} {{".Length;\n}\n#endregion\n\npublic record R(int A, string B);\n',
    "Swift": 'import Foundation\n\n@objc public final class X: Y, Z {\n    private var a: [String: Int]? = nil\n    let s = "v \\(a.map { "x" }) {"\n    func m(_ x: Int) -> Int { return x }\n    init() {}\n}\n\nprotocol P { func a() }\nextension X: P { func a() {} }\n',
    "Cpp": '#include <vector>\n#include "a.h"\n#define MAX(a, b) ((a) > (b) \\\n  ? (a) : (b))\n\nnamespace n {\ntemplate <typename T>\nclass X final : public Y<T> {\npublic:\n    virtual int m(int a) const = 0;\n    int n = 1\'000;\n    const char* s = R"x(un " closed { )x";\n};\n}\n\nint main() { char c = \'{\'; return 0; }\nstatic const int T[] = {1, 2};\n',
    "PHP": "<?php\nnamespace A\\B;\nuse C\\D;\n\n// it's open {\nfinal class X extends Y implements Z {\n    private ?int $a = null;\n    public function m(array $x = []): int { return <<<EOT\nun ' closed {\nEOT;\n    }\n}\nfunction f($a) { return $a; }\n?>\n<p>it's text {</p>\n",
    "Ruby": "require 'a'\n\n=begin\nit's { open\n=end\nmodule M\n  class X < Y\n    attr_reader :end_of, :a\n    def m(a, b = nil)\n      return 1 if a\n      x = if b then 1 else 2 end\n      [1].each do |i|\n        puts \"v #{h[\"k\"]} {\" unless i\n      end\n      t = <<~EOT\n        un ' closed do\n      EOT\n      t while false\n    end\n    def one = 1\n  end\nend\n",
    "Python": "import a\n\n\ndef f(x: int) -> str:\n    \"\"\"doc\n    >>>>>>> not a conflict\n    \"\"\"\n    return f'{x}' + \"{\"\n",
}
FOREIGN = {
    "prose": "# Title here\n\nThe probe reads every granary once and then hands it on to the audit.\n\n* keep the probe small\n* never call it twice\n",
    "html": "<!DOCTYPE html>\n<html>\n<body>\n<h1>502 gateway busy</h1>\n</body>\n</html>\n",
    "shell": "set -eu\nfor f in canal/*.txt; do\n  grep -c canal \"$f\"\ndone\n",
    "diff": "--- a/src/a.txt\n+++ b/src/a.txt\n@@ -1,2 +1,2 @@\n-one\n+two words here\n",
}
EXT = {"TypeScript": "ts", "Python": "py"}


@pytest.mark.parametrize("language", list(GOOD))
def test_whole_files_parse(language):
    text = GOOD[language]
    for form in (text, text.replace("\n", "\r\n"), "﻿" + text, ""):
        expected = "" if form or language != "Go" else "premature_end"
        assert S.fault(form.encode(), language, "a." + EXT.get(language, "x")) == expected


@pytest.mark.parametrize("language", list(GOOD))
def test_broken_files_are_found(language):
    text = GOOD[language]
    lines = text.split("\n")
    body = text.rstrip().rstrip("?>\n<p>it's text {</p>") if language == "PHP" else text.rstrip()
    assert S.fault(text.replace("\n", "\n<<<<<<< ours\n", 1).encode(), language) not in ("", None)
    middle = next(i for i, x in enumerate(lines) if i > 1 and x.startswith((" ", "\t")) and not any(y in x for y in ("doc", ">>>", '"""')))
    conflicted = "\n".join([*lines[:middle], "=======", ">>>>>>> topic/x-1", *lines[middle:]])
    assert S.fault(conflicted.encode(), language) not in ("", None)
    last = max(body.rfind("}"), body.rfind("end")) if language != "Python" else body.rfind("'{x}'") + 2
    assert S.fault(body[:last].encode(), language) not in ("", None)
    if language != "Python":
        assert S.fault((body + "\n)").encode(), language) not in ("", None)


@pytest.mark.parametrize("language", [x for x in GOOD if x != "PHP"])
@pytest.mark.parametrize("kind", list(FOREIGN))
def test_other_texts_are_found(language, kind):
    if (language, kind) == ("Ruby", "diff"):
        assert S.fault(FOREIGN[kind].encode(), language) != ""
    assert S.fault(FOREIGN[kind].encode(), language, "a." + EXT.get(language, "x")) not in ("", None)


@pytest.mark.parametrize("language", [x for x in GOOD if x != "PHP"])
def test_sources_of_other_languages_are_found(language):
    for other, text in GOOD.items():
        if other != language:
            assert S.fault(text.encode(), language, "a." + EXT.get(language, "x")) != "", other


def test_python_equals_its_parser():
    rnd = random.Random(1)
    text = GOOD["Python"] * 2
    for _ in range(300):
        at = rnd.randrange(len(text))
        cut = rnd.choice([text[:at], text[:at] + text[at + 1 :], text[:at] + rnd.choice("()[]{}'\":") + text[at:]])
        try:
            ast.parse(cut)
            want = True
        except (SyntaxError, ValueError):
            want = False
        assert (S.fault(cut.encode(), "Python") == "") == want, cut


def test_php_without_tag_is_output():
    assert S.fault(b"any text { at all", "PHP") == ""


def test_frame(spark):
    rows = [(1, "r", "a.py", "Python", b"x = (", "clash"), (2, "r", "b.py", "Python", b"x = 1", ""), (3, "r", "c.py", None, b"x = (", ""), (4, "r", "d.py", "Python", None, ""), (5, None, "e.xx", "Cobol", b"x", ""), (6, "r", "f.py", "Python", b"\xff\xfe\x00", ""), (7, "r", "g.py", "Python", b"# " + b"x" * 2_000_000, ""), (1, "r", "a.py", "Python", b"x = (", "")]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, language string, content binary, fault string")
    assert sorted(r["file_id"] for r in S.unparsable(df).collect()) == [1, 1, 6]
    report = {(r["repo"], r["language"]): r for r in S.report(df).collect()}
    assert report["r", "Python"]["n_files"] == 6 and report["r", "Python"]["n_broken"] == 3 and report["r", "Python"]["encoding"] == 1
    assert S.unparsable(df.limit(0)).count() == 0
