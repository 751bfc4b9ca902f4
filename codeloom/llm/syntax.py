"""Source files that do not parse: a lexer and a pushdown stack per language.

Each file goes through the lexer of its language, which takes comments and literals out and reports what never
ends. Lines of merge conflicts that are left then stand in code. A pushdown stack of delimiters (in Ruby, of block words
as well) runs over the rest and reports what does not pair. The blocks it finds cut the file into declarations, whose
heads are held against the forms the language has, so that text of another kind and files that end within a
declaration show. Literals that hold code, and comments that hold comments, are taken by a stack as well, to any depth. Python's
own parser looks at Python files that pass; what only it finds has a fault of its own, 'python_parser'.

Defined cases. Null content or a null or unknown language gives a null fault (unknown); empty content parses. A byte
order mark and any line ends are accepted. Bytes that are not UTF-8 are a fault ('encoding'). Repeated files are judged
each for itself. Files are read whole, whatever their length.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.extract.text import comment_end
from codeloom.runtime import spread

#: Faults a file can have.
FAULTS = ("encoding", "unterminated", "conflict", "unbalanced", "premature_end", "foreign", "grammar", "python_parser")

# --------------------------------------------------------------------------- lexers
# Alternatives of a lexer: k comment, b opener of comments that hold others, s literal, h literal up to its first hole, w a word
# to keep, u an opener without its end.

_LINE = r"//[^\n]*"
_HASH = r"\#[^\n]*"
_BLOCK = r"/\*[\s\S]*?\*/"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_DQ_LONG = r'"(?:[^"\\]|\\[\s\S])*"'
_SQ_LONG = r"'(?:[^'\\]|\\[\s\S])*'"
_TRIPLE = r'"""[\s\S]*?"""+'
_TRIPLE_ESC = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
#: Literals without a hole; what has one is left to the pushdown stack of HOLES.
_PLAIN = r'"(?!"")(?:[^"\\\n$]|\\[\s\S]|\$(?!\{))*"'
_PLAIN_TRIPLE = r'"""(?:[^"$]|"(?!"")|\$(?!\{))*"""+'
_OPEN = [r"/\*", '"', "'", "`"]

#: language -> (comments, literals, kept words, unterminated openers). Each alternative starts with one plain character, and
#: looks back over what has to stand before that, so that the lexer jumps from one such character to the next.
LEXERS: dict[str, tuple[list[str], list[str], list[str], list[str]]] = {
    "TypeScript": ([_LINE, _BLOCK], [_DQ, _SQ, r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}]*\})*\})*`"], [], _OPEN),
    "Rust": ([_LINE, _BLOCK], [r'"(?<=r")[^"]*"', r'\#(?<=r\#)(?P<n1>\#*)"[\s\S]*?"\#(?P=n1)', _DQ_LONG, r"'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x..|.))'"], [r"'[A-Za-z_]\w*"], _OPEN),
    "Go": ([_LINE, _BLOCK], [_DQ, r"`[^`]*`", _CHAR], [], _OPEN),
    "Java": ([_LINE, _BLOCK], [_TRIPLE_ESC, _DQ, _CHAR], [], _OPEN),
    "Kotlin": ([_LINE, _BLOCK], [_PLAIN_TRIPLE, _PLAIN, _CHAR], [r"`[^`\n]+`"], _OPEN),
    "CSharp": ([_LINE, _BLOCK], [r'"""+[\s\S]*?"""+', r'"(?<=@")(?:[^"]|"")*"', r'"(?<=@\$")(?:[^"{]|""|\{\{)*"', r'"(?<=[^@]\$")(?:[^"\\\n{]|\\[^\n]|\{\{)*"', r'"(?<!\$")(?<!\$@")(?:[^"\\\n]|\\[\s\S])*"', _CHAR], [], _OPEN),
    "Swift": ([_LINE, _BLOCK], [r'"""(?:[^"\\]|\\[^(]|"(?!""))*"""', r'\#(?P<n1>\#*)"""[\s\S]*?"""\#(?P=n1)', r'\#(?P<n2>\#*)"[^\n]*?"\#(?P=n2)', r'"(?!"")(?:[^"\\\n]|\\[^(\n])*"'], [r"`\w+`"], [r"/\*", '"', "`"]),
    "Cpp": ([_LINE, _BLOCK], [r'"(?<=R")(?P<n1>[^()\\\s]{0,16})\([\s\S]*?\)(?P=n1)"', _DQ, r"'(?<![0-9a-fA-F]')(?:[^'\\\n]|\\[^\n][^'\n]*)+'"], [r"'(?<=[0-9a-fA-F]')(?=[0-9a-fA-F])"], _OPEN),
    "PHP": ([_LINE, r"\#(?!\[)[^\n]*", _BLOCK], [r"<<<[ \t]*(?P<n1>[\"']?)(?P<n2>\w+)(?P=n1)\n[\s\S]*?\n?[ \t]*(?P=n2)\b", _DQ_LONG, _SQ_LONG, r"`[^`]*`"], [], _OPEN),
    "Scala": ([_LINE, _BLOCK], [_PLAIN_TRIPLE, r'"(?<!\w")""[\s\S]*?"""+', _PLAIN, r'"(?<!\w")(?:[^"\\\n]|\\[\s\S])*"', _CHAR], [r"`[^`\n]+`", r"'[A-Za-z_]\w*"], _OPEN),
    "Ruby": (
        [r"=(?<![^\n]=)begin\b[\s\S]*?\n=end\b[^\n]*", _HASH, r"_(?<![^\n]_)_END__(?=\n|\Z)[\s\S]*"],
        [r'"(?:[^"\\#]|\\[\s\S]|\#(?!\{))*"', _SQ_LONG, r"`[^`]*`", r"<<[~-]?(?P<n1>[\"'`]?)(?P<n2>[A-Z_]\w*)(?P=n1)[^\n]*\n(?:[\s\S]*?\n)??[ \t]*(?P=n2)\b", r"%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|\|[^|]*\|)", r"/(?:(?<=[(,=~|&!]/)|(?<=[(,=~|&!] /)|(?<=if /)|(?<=when /)|(?<=unless /))(?:[^/\\\n]|\\.)+/[imxounse]*"],
        [],
        [r"=(?<![^\n]=)begin\b", '"', "'", "`"],
    ),
    "Python": ([_HASH], [r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"", r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''", _DQ, _SQ], [], ['"', "'"]),
}
#: language -> literals that hold code: (what has to stand before and at the start, end, opener of a hole, its end, escapes, whether they run over lines).
HOLES: dict[str, list[tuple[str, str, str, str, str, bool]]] = {
    "Kotlin": [(r'"""', '"""', "${", "}", "", True), (r'"', '"', "${", "}", "\\", False)],
    "Scala": [(r'(?<=\w)"""', '"""', "${", "}", "", True), (r'(?<=\w)"', '"', "${", "}", "\\", False)],
    "Swift": [(r'"""', '"""', "\\(", ")", "\\", True), (r'"', '"', "\\(", ")", "\\", False)],
    "CSharp": [(r'(?<=@\$)"', '"', "{", "}", '""', True), (r'(?<=\$@)"', '"', "{", "}", '""', True), (r'(?<=\$)"', '"', "{", "}", "\\", False)],
    "Ruby": [(r'"', '"', "#{", "}", "\\", True)],
}
_NESTING = {"Rust", "Kotlin", "Swift", "Scala"}
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)
_DELIMITER = re.compile(r"[(){}\[\]]")
_CLOSES = {")": "(", "]": "[", "}": "{"}


@cache
def _lexer(language: str) -> re.Pattern:
    comments, literals, words, openers = LEXERS[language]
    if language in _NESTING:
        comments, block = [x for x in comments if x != _BLOCK], [r"/\*"]
    else:
        block = []
    firsts: set[str] = set()
    parts = []
    for name, group in (("k", comments), ("b", block), ("s", literals), ("h", _hole_starts(language)), ("w", words), ("u", openers)):
        tails = []
        for x in group:
            first = re.match(r"\\?.", x)[0]
            firsts.add(first)
            tails.append(f"(?<={first}){x[len(first) :]}")
        if tails:
            parts.append(f"(?P<{name}>{'|'.join(tails)})")
    return re.compile(f"[{''.join(sorted(firsts))}](?:{'|'.join(parts)})")


class Fault(Exception):
    """What is wrong with a file."""


def lexemes(text: str, language: str, at: int = 0) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each comment 'k', literal 's', kept word 'w' and opener without its end 'u', in order."""
    find = _lexer(language).search
    while m := find(text, at):
        start, kind = m.start(), m.lastgroup
        at = m.end()
        if kind == "b":
            end = comment_end(text, start)
            kind, at = ("k", end) if end >= 0 else ("u", at)
        elif kind == "h":
            end = _filled_end(text, start, language)
            kind, at = ("s", end) if end >= 0 else ("u", at)
        yield start, at, kind


def _filled_end(text: str, at: int, language: str) -> int:
    """The end of a literal with holes, whose code may hold such literals again, by a pushdown stack; -1 if it has none."""
    find, n = _lexer(language).search, len(text)
    stack: list = [_hole_literal(text, at, language)]
    at += len(stack[0][1])
    while stack:
        top = stack[-1]
        if isinstance(top, tuple):  # within a literal
            _, end, opener, close, escape, lines = top
            m = _literal_stop(end, opener, escape, lines).search(text, at)
            if not m or m[0] == "\n":
                return -1
            at = m.end()
            if m[0] == opener:
                stack.append(close)
            elif m[0].startswith(end) and (m[0] == end or len(end) > 1):
                stack.pop()
                if not stack:
                    return at
        else:  # within a hole: stack holds the delimiters that have to close
            d, m = _DELIMITER.search(text, at), find(text, at)
            if m and (not d or m.start() <= d.start()):
                kind = m.lastgroup
                if kind == "h":
                    inner = _hole_literal(text, m.start(), language)
                    stack.append(inner)
                    at = m.start() + len(inner[1])
                elif kind == "u":
                    return -1
                elif kind == "b":
                    at = comment_end(text, m.start())
                    if at < 0:
                        return -1
                else:
                    at = m.end()
            elif not d:
                return -1
            else:
                at = d.end()
                if d[0] in "([{":
                    stack.append({"(": ")", "[": "]", "{": "}"}[d[0]])
                elif d[0] != stack.pop():
                    return -1
    return min(at, n)


@cache
def _hole_patterns(language: str) -> list[tuple[re.Pattern, tuple]]:
    return [(re.compile(row[0]), row) for row in HOLES.get(language, [])]


def _hole_literal(text: str, at: int, language: str) -> tuple:
    return next(row for p, row in _hole_patterns(language) if p.match(text, at))


@cache
def _literal_stop(end: str, opener: str, escape: str, lines: bool) -> re.Pattern:
    """What ends a literal, opens a hole, is an escape, or ends a line that it may not run over."""
    skip = {"\\": r"\\(?!\()[\s\S]" if opener == "\\(" else r"\\[\s\S]", '""': '""', "": ""}[escape]
    ends = re.escape(end) + ('"*' if len(end) > 1 else "")
    parts = [re.escape(opener * 2)] * (opener == "{") + [re.escape(opener), skip, ends, "" if lines else r"\n"]
    return re.compile("|".join(p for p in parts if p))


def _hole_starts(language: str) -> list[str]:
    """Starts of literals with holes for the lexer: they come after the alternatives without holes, so those did not fit."""
    out = []
    for start, end, opener, _, escape, lines in HOLES.get(language, []):
        look = re.match(r"\(\?<=([^)]*)\)", start)
        before = f"(?<={look[1]}{end[0]})" if look else ""
        body = _literal_body(end, opener, escape, lines)
        out.append(f"{end[0]}{before}{re.escape(end[1:])}{body}{re.escape(opener)}")
    return out


def _literal_body(end: str, opener: str, escape: str, lines: bool) -> str:
    first = re.escape(opener[0])
    stop = '"' + ("" if lines else r"\n")
    parts = []
    if escape == "\\":
        parts.append(r"\\[^(]" if opener == "\\(" else r"\\[\s\S]")
        stop += r"\\"
    elif escape == '""':
        parts.append('""')
    if opener == "{":
        parts.append(r"\{\{")
    elif opener[0] != "\\":
        parts.append(f"{first}(?!{re.escape(opener[1:])})")
    if len(end) > 1:
        parts.append('"(?!"")')
    return f"(?:[^{stop}{first}]|{'|'.join(parts)})*"


def lex(text: str, language: str) -> str:
    """text with comments blanked and literals as empty strings; raises Fault on what never ends."""
    out, at = [], 0
    for start, end, kind in lexemes(text, language):
        if kind == "u":
            raise Fault("unterminated")
        out.append(text[at:start])
        at = end
        if kind == "w":
            out.append(text[start:end].replace("'", "").replace("`", "") or "_")
            continue
        lines = text.find("\n", start, end) >= 0
        if kind == "k":
            out.append("\n" if lines else " ")
        else:
            out.append('""' + "\n" * (lines and language == "Ruby" and text.startswith("<<", start)))
    out.append(text[at:])
    return "".join(out)


# --------------------------------------------------------------------------- pushdown stack


class Block:
    """A delimited part of a file; parts are the blocks right within it."""

    __slots__ = ("end", "kind", "parts", "start")

    def __init__(self, kind: str, start: int) -> None:
        self.kind, self.start, self.end, self.parts = kind, start, start, []


def blocks(text: str) -> Block:
    """The tree of delimiters of lexed text; raises Fault where they do not pair."""
    top = Block("", -1)
    stack = [top]
    for m in _DELIMITER.finditer(text):
        c = m[0]
        if c in "([{":
            block = Block(c, m.start())
            stack[-1].parts.append(block)
            stack.append(block)
        else:
            if stack[-1].kind != _CLOSES[c]:
                raise Fault("unbalanced")
            stack.pop().end = m.start()
    if len(stack) > 1:
        raise Fault("premature_end")
    top.end = len(text)
    return top


_NO_DELIMITER = re.compile(r"[^(){}\[\]]+")


def balance(text: str) -> None:
    """The pushdown stack alone, for languages where the top of the file is all that is looked at."""
    marks = _NO_DELIMITER.sub("", text)
    for _ in range(4):  # pairs that follow each other are what a push and a pop would meet; what is left takes the stack
        marks = marks.replace("()", "").replace("[]", "").replace("{}", "")
    stack: list[str] = []
    for c in marks:
        if c in "([{":
            stack.append(c)
        elif not stack or stack.pop() != _CLOSES[c]:
            raise Fault("unbalanced")
    if stack:
        raise Fault("premature_end")


def _balanced(text: str) -> bool:
    try:
        balance(text)
    except Fault:
        return False
    return True


def flat(text: str) -> str:
    """Balanced text with every outermost block as its empty pair of delimiters, in one pass."""
    out, depth, at = [], 0, 0
    for m in _DELIMITER.finditer(text):
        if m[0] in "([{":
            if not depth:
                out.append(text[at : m.end()])
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                at = m.start()
    return "".join([*out, text[at:] if not depth else ""])


def type_bodies(text: str, block: Block) -> Iterator[tuple[Block, str]]:
    """Each brace block right within a block with the head before it, from the end of the declaration before; blocks within the head as pairs."""
    head, at = "", block.start + 1
    for part in block.parts:
        head += text[at : part.start]
        at = part.end + 1
        if part.kind == "{":
            yield part, re.split(r"[;}]|\n\s*\n", head)[-1]
            head = ""
        else:
            head += text[part.start] + text[part.end]


def outline(text: str, block: Block) -> str:
    """The text right within a block, each inner block as its empty pair of delimiters."""
    out, at = [], block.start + 1
    for part in block.parts:
        out.append(text[at : part.start])
        out.append(text[part.start] + text[part.end])
        at = part.end + 1
    out.append(text[at : block.end])
    return "".join(out)


# --------------------------------------------------------------------------- forms of declarations

_TYPES = r"[\w$.<>?&|:*@!'\s,()\[\]\"-]+"
_GENERIC = r"(?:<[^{};]*>)?"


def _mods(words: str, extra: str = "") -> str:
    return rf"(?:(?:{words})\b(?:\(\)|\[\])?\s*{extra})*"


#: Forms a declaration may have at the top of a file; a declaration ends at a semicolon or a block.
_JAVA_MODS = rf"(?:@(?!interface\b)[\w.]+\s*(?:\(\))?\s*|(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp|default|synchronized|native|transient|volatile)\b\s*)*"
_CS_MODS = r"(?:\[\]\s*|(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe|new|file|ref|virtual|override|async|extern|const|required|volatile|event|implicit|explicit)\b\s*)*"
_RS_MODS = r"(?:\#!?\[\]\s*|pub\b\s*(?:\(\))?\s*|(?:unsafe|async|default|const|extern)\b\s*(?:\"\")?\s*)*"
TOPS = {
    "Java": re.compile(
        rf"(?:(?:@[\w.]+\s*(?:\(\))?\s*)*package\s+[\w.]+|import\s+(?:static\s+)?[\w.]+(?:\.\*)?|import\s+module\s+[\w.]+|{_JAVA_MODS}(?:class|interface|enum|record|@interface)\s+\w+\s*{_GENERIC}\s*(?:\(\))?\s*(?:(?:extends|implements|permits)\s[\w.,<>?&@\s()]+)*|(?:open\s+)?module\s+[\w.]+|{_JAVA_MODS}[\w.]+\s*{_GENERIC}(?:\[\])*\s+\w+\s*\(\)\s*(?:throws\s[\w.,\s]+)?)"
    ),
    "CSharp": re.compile(
        rf"(?:(?:global\s+)?using\s+(?:static\s+|unsafe\s+)?(?:\w+\s*=\s*)?[\w.:<>,?\s]+|extern\s+alias\s+\w+|namespace\s+[\w.]+|\[\]|{_CS_MODS}(?:class|struct|interface|enum|record(?:\s+(?:struct|class))?)\s+\w+\s*{_GENERIC}\s*(?:\(\))?\s*(?::\s*[\w.:]+\s*{_GENERIC}\s*(?:\(\))?(?:\s*,\s*[\w.:]+\s*{_GENERIC})*\s*)?(?:where\s[\w.,<>?:\s()]+)*|{_CS_MODS}delegate\s[\s\S]+|(?:var|await|return|if|for|foreach|while|try|throw|switch|do|else|catch|finally|lock|using)\b[\s\S]*|[\w.]+\s*(?:\(\)|=)[\s\S]*|{_CS_MODS}[\w.<>,?]+(?:\[\])*\s+\w+\s*(?:\(\)|=)[\s\S]*)"
    ),
    "Rust": re.compile(
        rf"(?:{_RS_MODS}(?:use\s+[\w:*,\s{{}}]+|mod\s+\w+|fn\s+\w+\s*{_GENERIC}\s*\(\)[\s\S]*|(?:struct|enum|union)\s+\w+[\s\S]*|(?:auto\s+)?trait\s+\w+[\s\S]*|impl\b[\s\S]*|(?:static|const)\s+(?:mut\s+)?\w+\s*:[\s\S]*|type\s+\w+[\s\S]*|crate\s+\w+(?:\s+as\s+\w+)?)|{_RS_MODS}macro_rules!\s*\w+\s*(?:\(\))?|\#!\[\]|[\w:]+!\s*\w*\s*(?:\(\)|\[\])?|{_RS_MODS}[A-Z_][A-Z0-9_]*\s*:[\s\S]*|extern\s*(?:\"\")?)"
    ),
}

_WORD = r"[A-Za-z_$\u0080-￿][\w$]*"
#: Words after which another word may stand in TypeScript and JavaScript, and words that may stand after any word.
_JS_BEFORE = "abstract accessor any as assert asserts async await break case catch class const constructor continue debugger declare default delete do else enum export extends finally for from function get global if implements import in infer instanceof interface is keyof let module namespace never new of out override private protected public readonly return satisfies set static super switch throw try type typeof unique using var void while with yield"  # noqa: E501
_JS_AFTER = "as in of instanceof is extends implements from satisfies else while catch finally"
_JS_FIRST, _JS_SECOND = frozenset(_JS_BEFORE.split()), frozenset(_JS_AFTER.split())
_JS_PAIR = re.compile(rf"(?<![\w$.@#\u0080-￿])({_WORD})[ \t]+(?=({_WORD}))")
_JS_SLASH = re.compile(r"/(?![/*=\s])")
_THREE = re.compile(rf"(?<![\w.$@#]){_WORD}[ \t]+{_WORD}[ \t]+{_WORD}[ \t]+{_WORD}[ \t]+{_WORD}")

#: First words that declare something, and words that may stand before them.
_KT_MODS = "public|private|internal|protected|open|abstract|final|sealed|data|enum|annotation|inline|value|inner|companion|override|suspend|operator|infix|tailrec|external|const|lateinit|actual|expect|noinline|crossinline|vararg"
_SW_MODS = "public|private|fileprivate|internal|open|package|final|static|class|mutating|nonmutating|override|indirect|lazy|weak|unowned|required|convenience|dynamic|optional|prefix|postfix|infix|nonisolated|isolated|distributed|async|consuming|borrowing"
_SC_MODS = "private|protected|final|sealed|abstract|implicit|lazy|override|case|inline|open|opaque|transparent|infix|erased"
HEADS = {
    "Kotlin": re.compile(
        rf"(?:@[\w.:]+\s*(?:\(\))?\s*|(?:{_KT_MODS})\b\s*)*(?:package\s+[\w.]+$|import\s+[\w.]+(?:\.\*)?(?:\s+as\s+\w+)?$|(?:fun\s+)?(?:class|interface)\s+\w+\s*{_GENERIC}\s*(?:(?:@[\w.]+\s*|private\s+|internal\s+|protected\s+|public\s+)*constructor\s*)?(?:\(\))?\s*(?::(?!:)\s*[^;={{}}]+?)?\s*(?:\{{\}})?$|object\b\s*\w*\s*(?::[^;=]+)?(?:\{{\}})?$|fun\b[\s\S]*$|va[lr]\s[\s\S]*$|typealias\s+\w+[\s\S]*=[\s\S]*$|constructor\s*\(\)[\s\S]*$|init\s*\{{\}}$|get\b[\s\S]*$|set\b[\s\S]*$|\#!.*$)"
    ),
    "Swift": re.compile(
        rf"(?:@\w+\s*(?:\(\))?\s*|(?:{_SW_MODS})\b\s*(?:\(\))?\s*)*(?:import\s+(?:class\s+|struct\s+|func\s+|enum\s+|protocol\s+|typealias\s+|var\s+)?[\w.]+$|(?:class|struct|enum|protocol|extension|actor)\s+[\w.]+\s*{_GENERIC}\s*(?::(?!:)\s*[\w.,<>&@?:\s()\[\]]+)?(?:where\s[^{{]+)?\{{\}}$|class\s+(?:func|var|let|subscript)\b[\s\S]*$|func\s*[^\s(]+[\s\S]*\(\)[\s\S]*$|(?:let|var)\s+[\w(][\s\S]*$|typealias\s+\w+[\s\S]*=[\s\S]*$|init[?!]?\s*{_GENERIC}\s*\(\)[\s\S]*$|deinit\s*\{{\}}$|subscript\b[\s\S]*$|case\s[\s\S]*$|associatedtype\s+\w+[\s\S]*$|operator\s[\s\S]*$|precedencegroup\s[\s\S]*$|macro\s[\s\S]*$|\#(?:if|elseif|else|endif|warning|error|available|sourceLocation|Preview)\b.*$)"
    ),
    "Scala": re.compile(
        rf"(?:@\w+\s*(?:\(\))?\s*|(?:{_SC_MODS})\b\s*(?:\[\])?\s*)*(?:package\s+(?:object\s+)?[\w.]+\s*:?\s*(?:\{{\}}|extends[\s\S]*)?$|(?:import|export)\s+\w+\.[\w.]*\w?(?:\.?(?:\{{\}}|[_*]|given))?(?:\s*,\s*[\w.]+(?:\.(?:\{{\}}|[_*]))?)*(?:\s+as\s+\w+)?$|(?:class|object|trait|enum|case)\s+\w+\s*(?:\[\])?\s*(?:private\s*|protected\s*|@\w+\s*)*(?:\(\)\s*)*(?:(?:extends|with|derives)\s+[\w.,&\s()\[\]]+)*:?\s*(?:\{{\}})?$|def\s[\s\S]*$|va[lr]\s[\s\S]*$|type\s+\w+[\s\S]*$|given\b[\s\S]*$|extension\s*(?:\[\])?\s*\(\)[\s\S]*$|end\s+\w+$|this\b[\s\S]*$)"
    ),
}
#: A line that goes on from the one before, and one that the next goes on from, where line ends end declarations.
_GOES_ON = re.compile(r"\s*(?:[.?:,=)\]}&|+*/]|->|where\b|extends\b|with\b|else\b|catch\b|finally\b|derives\b)")
_UNDONE = re.compile(r"(?:[,=.:&|+*/(\[-]|->|=>|\bextends|\bwith|\bwhere|\belse)\s*$")

_GO_TOP = re.compile(r"(?:import\s*(?:[\w.]+\s+)?\"\"|import\s*\(\)|func\s*(?:\(\)\s*)?\w+\s*(?:\[\])?\s*\(\)[^;=]*|type\s+\w+\s*[\w(*\[=<.][\s\S]*|type\s*\(\)|(?:var|const)\s+\w[\s\S]*|(?:var|const)\s*\(\))$")
_GO_UNDONE = re.compile(r"(?:\[\]|[,=.:&|+*/(\[<>-]|\b(?:struct|interface|func|type|var|const|import|package|map|chan))\s*$")
_CPP_DIRECTIVE = re.compile(r"^[ \t]*\#[ \t]*(?:(?:include|define|undef|if|ifdef|ifndef|elif|elifdef|elifndef|else|endif|error|warning|pragma|line|import|include_next|embed)\b|$|\d)")
_CS_DIRECTIVE = re.compile(r"^[ \t]*\#[ \t]*(?:if|elif|else|endif|define|undef|line|error|warning|region|endregion|pragma|nullable|r|load|!)\b")
#: Declarations that a body of the language cannot hold.
BODIES = {
    "Rust": re.compile(r"\b(?:func|fun|def|var|class|private|function)\s+\w+\s*[(:<{]"),
    "CSharp": re.compile(r"\b(?:func|fun|def|fn|let|val)\s+\w+\s*[(:]|\bvar\s+\w+\s*:|\b(?:public|private|protected)\s*:"),
    "Java": re.compile(r"\b(?:readonly|function|func|fun|def|fn|let|val|constructor)\s+\w+\s*[(:=<]|\b(?:public|private|protected)\s*:"),
    "Cpp": re.compile(r"\b(?:func|fun|def|fn|val)\s+\w+\s*\([^)]*\)\s*(?:->|:|\{|=)|\bfunction\s*\w*\s*\("),
    "Kotlin": re.compile(r"\[\]\s*\w|\bfunc\s+\w+\s*\("),
    "Scala": re.compile(r"\[\]\s*\w|\bfunc\s+\w+\s*\("),
}
_DIRECTIVES = re.compile(r"^[ \t]*\#(?:[^\\\n]|\\\n?)*", re.M)
_CPP_BAD = re.compile(
    r"(?:public|private|protected)\b(?!\s*:)|(?:package|import|export|func|fn|fun|def|from|require|pub|impl|trait|mod|use|let|function|interface|module|internal|final|abstract|override|sealed|object|val|attr_reader|attr_accessor|end)\b(?!\s*[(=;:\[<]|\s*$|::)|(?:class|struct|union)\s+\w+\s+(?!final\b|\w+\s*(?::|\{|;|=|\(\)|$))\w|\w+\s+\w+\s*\.\s*\w|\w[\w\s]*\s\w+\s*\(\)\s*:(?!:)\s*[\w<>\[\]| ]+$|[@<>/.?(!{\"\d]"
)


_CUT = re.compile(r"(;|\{\})")
_VALUE_BLOCK = re.compile(r"(?:=\s*(?:\[\])?[\w.<>:&*\s\[\]\"]*(?:\(\))?\s*|::\s*|=>\s*)\{\}$")


def _pieces(text: str) -> list[tuple[str, bool]]:
    """Declarations of flat text in a language of semicolons: (text, whether a block ends it); the last one has no end."""
    out: list[tuple[str, bool]] = []
    head = ""
    for part in _CUT.split(text):
        if part == ";":
            out.append((head.strip(), False))
            head = ""
        else:
            head += part
            if part == "{}" and not _VALUE_BLOCK.search(head):
                out.append((head.strip(), True))
                head = ""
    out.append((head.strip(), False))
    return out


def _semicolons(text: str, language: str) -> None:
    """Java, C#, Rust: every declaration at the top has one of the language's forms and an end."""
    form = TOPS[language]
    pieces = _pieces(flat(text))
    rest = pieces.pop()[0]
    for head, block in pieces:
        if not head:
            continue
        plain = head[:-2].rstrip() if block else head
        if not form.fullmatch(plain):
            raise Fault("foreign")
        if not block and language != "Rust" and re.search(r"\b(?:class|interface|enum)\s+\w+", plain) and "(" not in plain and not re.match(r"using|import|package", plain):
            raise Fault("grammar")  # a type without a body
        if block and language != "Rust" and re.match(r"(?:package|import|using)\b", plain):
            raise Fault("foreign")
    if not rest:
        return
    if language == "Rust" and re.fullmatch(r"(?:\#!\[\]\s*)+|[\w:]+!\s*(?:\(\)|\[\]|\{\})|(?:pub\s+)?use\b[\s\S]*\{\}", rest):
        return
    if language == "CSharp" and re.fullmatch(r"(?:\[\]\s*)+", rest) and "assembly" in text:
        return
    raise Fault("premature_end" if form.fullmatch(rest) or rest.startswith(("@", "#", "[")) else "foreign")


def _lines(text: str, block: Block) -> list[str]:
    """Declarations of a block in a language where line ends end them."""
    out: list[str] = []
    for line in re.split(r"[\n;]", outline(text, block)):
        if not line.strip():
            continue
        if out and not out[-1].startswith("import ") and (_GOES_ON.match(line) or _UNDONE.search(out[-1]) or re.fullmatch(r"\s*\{\}", line) or re.fullmatch(r"(?:\s*@[\w.:]+(?:\s*\(\))?)+\s*", out[-1])):
            out[-1] += " " + line.strip()
        else:
            out.append(line.strip())
    return out


_TYPE_HEAD = re.compile(r"\b(?:class|interface|object|struct|protocol|extension|trait|actor)\b[^={}]*\{?$")


def _declared(text: str, top: Block, language: str) -> None:
    """Kotlin, Swift, Scala: each line at the top and within a type declares something."""
    form = HEADS[language]
    todo = [(top, True)]
    while todo:
        block, is_top = todo.pop()
        for line in _lines(text, block):
            if not form.match(line):
                if language == "Swift" and is_top and re.match(r"(?:if|for|while|guard|switch|do|return|try|await|print|[\w.]+(?:\(\)|\s*[-+*/]?=[^=]))", line) and not re.search(r"[{:]$", line[:-2] if line.endswith("{}") else line):
                    continue
                if not is_top and language == "Scala" and not re.match(rf"(?:{_SC_MODS}|public|static)\b", line) and not _THREE.match(line):
                    continue  # an expression in a template
                if not is_top and re.match(r"\w+(?:\(\))?\s*(?:,|$)", line):
                    continue  # entries of an enumeration
                if language == "Kotlin" and re.match(r"[\w.]+\s*(?:\(\)|\{\})", line) and "build" in text:
                    continue
                raise Fault("foreign")
            if (_UNDONE.search(line) and not line.startswith("import ")) or re.fullmatch(rf"(?:@[\w.:]+\s*(?:\(\))?\s*|(?:{_KT_MODS if language == 'Kotlin' else _SW_MODS if language == 'Swift' else _SC_MODS})\b\s*)+", line):
                raise Fault("premature_end")
        todo += [(part, False) for part, head in type_bodies(text, block) if _TYPE_HEAD.search(head)]


def _go(text: str) -> None:
    lines = [x.strip() for x in re.split(r"[\n;]", flat(text))]
    lines = [x for x in lines if x]
    if not lines:
        raise Fault("premature_end")  # a package clause is required
    if not re.fullmatch(r"package\s+\w+", lines[0]):
        raise Fault("foreign")
    joined: list[str] = []
    for line in lines[1:]:
        if joined and _GO_UNDONE.search(joined[-1]):
            joined[-1] += " " + line
        else:
            joined.append(line)
    late = False
    for line in joined:
        if not _GO_TOP.match(line):
            raise Fault("premature_end" if line in ("import", "func", "type", "var", "const") or _GO_UNDONE.search(line) else "foreign")
        if _GO_UNDONE.search(line):
            raise Fault("premature_end")
        if line.startswith("import"):
            if late:
                raise Fault("grammar")
        else:
            late = True


_CPP_WORDS = re.compile(r"\b(?:unsigned|signed|long|short|int|char|double|const|static|inline|constexpr|extern|volatile|virtual|explicit|typename|class|struct|enum|template|auto|friend|mutable|register|thread_local|union|using|namespace|typedef|operator|noexcept|override|final|consteval|constinit|co_return|requires|concept)\b")
_CPP_TYPE = re.compile(r"(?:class|struct|union|enum)\b[^()=]*\{\}$")
_CPP_NEXT = re.compile(r"(?:class|struct|union|enum|namespace|template|using|typedef)\b")


def _cpp(text: str) -> None:
    pieces = _pieces(flat(text))
    rest = pieces.pop()[0]
    for head, _ in pieces:
        if head and (_CPP_BAD.match(head) or _THREE.search(_CPP_WORDS.sub("(", head))):
            raise Fault("foreign")
    if rest:
        raise Fault("foreign" if _CPP_BAD.match(rest) else "premature_end")
    for i, (head, block) in enumerate(pieces):
        if block and _CPP_TYPE.match(head) and (i + 1 == len(pieces) or _CPP_NEXT.match(pieces[i + 1][0])):
            raise Fault("grammar")  # a type needs its semicolon


_PHP_WORDS = re.compile(r"\b(?:abstract|final|class|interface|trait|enum|extends|implements|static|public|private|protected|function|namespace|use|const|new|return|readonly|case|as|insteadof|instanceof|and|or|xor|throw|echo|print|global|if|else|elseif|while|for|foreach|switch|try|catch|finally|declare|do|goto|include|include_once|require|require_once|yield|from|clone|unset|isset|empty|exit|die|match|default|break|continue)\b")
_PHP_BAD = re.compile(r"(?:package|import|from|def|fn\s+\w|func|pub|impl|using|let)\b(?!\s*\()|[@*<]")


def _php_part(text: str, at: int) -> tuple[str, int]:
    """(lexed code from at on, place after the tag that ends it or the end of the text)."""
    out: list[str] = []
    for start, end, kind in lexemes(text, "PHP", at):
        gap, found = text[at:start], text[start:end]
        if (k := gap.find("?>")) >= 0:
            out.append(gap[:k] + ";")
            return "".join(out), at + k + 2
        out.append(gap)
        if kind == "u":
            raise Fault("unterminated")
        if kind == "k" and not found.startswith("/*") and (k := found.find("?>")) >= 0:
            return "".join(out) + ";", start + k + 2  # a tag ends a comment of one line, too
        out.append('""' if kind == "s" else "\n" if "\n" in found else " ")
        at = end
    tail = text[at:]
    k = tail.find("?>")
    return "".join(out) + (tail if k < 0 else tail[:k] + ";"), len(text) if k < 0 else at + k + 2


def _php(text: str) -> None:
    """Only what stands between the tags is PHP; anything else is output."""
    tag = re.compile(r"<\?(?:php\b|=)", re.I)
    code = []
    opened = tag.search(text)
    while opened:
        part, end = _php_part(text, opened.end())
        code.append(part)
        opened = tag.search(text, end)
    if not code:
        return
    body = "\n".join(code)
    if _CONFLICT.search(body):
        raise Fault("conflict")
    balance(body)
    pieces = _pieces(flat(body))
    rest = pieces.pop()[0]
    for head, _ in pieces:
        if _PHP_BAD.match(head) or _THREE.match(_PHP_WORDS.sub("(", head)):
            raise Fault("foreign")
    if rest:
        raise Fault("premature_end")


_RB_TOKEN = re.compile(r"(?<![\w.:@$])(?:(?P<open>class|module|def|begin|case|do|for)|(?P<cond>if|unless|while|until)|(?P<end>end)|(?P<mid>else|elsif|when|rescue|ensure|in|then))\b(?![?!:=]|\s*=[^=~>])|(?P<nl>[\n;])|(?P<br>[(){}\[\]])|(?P<w>[^\s\w(){}\[\];]+|[\w.@$:?!]+)")
_RB_BAD_LINE = re.compile(r"^[ \t]*(?:[<>*=/?|%,]|&&|\|\||(?:package|import|using|namespace|use|from|export|const|let|var|function|fn|func|fun|pub|impl|public|final|static|interface|struct|enum|type)\b[^\n]*[;{]$|(?:func|fn|fun|impl|pub|interface)\s+\w+[^\n]*\{|import\s*\{|@@ |pub\s+static\b|from\s+\S+\s+import\b|(?:async\s+)?def\s[^\n]*:$|class\s[^\n;]*[:{]$|#include)", re.M)


_RB_DEF = re.compile(r"def\s+(?:[\w?!=]+\.)*(?:\w+[?!]?|[^\s\w(]+)[ \t]*")
_RB_BODY = re.compile(r"[ \t]*=\s*[^=~>\s]")


def _endless(text: str, at: int) -> bool:
    """Whether the method that starts at a place has its body behind a =, whatever its parameters."""
    m = _RB_DEF.match(text, at)
    if not m:
        return False
    end, depth = m.end(), 0
    if text[end : end + 1] == "(":
        for d in _DELIMITER.finditer(text, end):
            depth += 1 if d[0] in "([{" else -1
            if not depth:
                end = d.end()
                break
        else:
            return False
    return bool(_RB_BODY.match(text, end))


def _ruby(text: str) -> None:
    stack: list[str] = []
    fresh, loop, last = True, False, ""
    for m in _RB_TOKEN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "nl":
            fresh, loop = last not in (",", ".", "&&", "||", "+", "-", "\\", "=") or token == ";", False
            continue
        if kind == "br":
            if token in "([{":
                stack.append(token)
            elif not stack or stack.pop() != _CLOSES[token]:
                raise Fault("unbalanced")
            fresh = token in "([{"
        elif kind == "open":
            if token == "do" and loop:
                loop = False
            elif not (token == "def" and _endless(text, m.start())) and not (token == "class" and last == "<<"):
                stack.append(token)
            loop = loop or token == "for"
            fresh = token in ("begin", "do")
        elif kind == "cond":
            if fresh or last in ("=", "(", "[", "||", "&&", "+=", "||=", "return", "<<", ","):
                stack.append(token)
                loop = token in ("while", "until")
            fresh = False
        elif kind == "end":
            if not stack or stack.pop() in "([{":
                raise Fault("unbalanced")
            fresh = False
        elif kind == "mid":
            if token in ("then", "elsif", "when") and not stack:
                raise Fault("foreign")
            fresh = True
        else:
            fresh = token in ("=>", "->") and False
        last = token
    if stack:
        raise Fault("premature_end")
    if last in (",", ".", "&&", "||", "+", "=", "*", "<", "->", "=>", "\\"):
        raise Fault("premature_end")
    bad = _RB_BAD_LINE.search(text)
    while bad:
        before = text[: bad.start()].rstrip()
        if not before.endswith((",", "(", "[", "{", "&&", "||", "+", "|")):
            raise Fault("foreign")
        bad = _RB_BAD_LINE.search(text, bad.end())


# --------------------------------------------------------------------------- JavaScript with literals that need context

_JS_TOKEN = re.compile(r"\s+|//[^\n]*|/\*[\s\S]*?\*/|" + _DQ + "|" + _SQ + r"|[A-Za-z_$\u0080-￿][\w$]*|\d[\w.]*|[(){}\[\]`]|[^\w\s(){}\[\]`\"'/<]+|[/<\"'`\\]|.")
_JS_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TAG = re.compile(r"<(?:[A-Za-z_][\w.-]*|>)")
_TYPE_PARAMETERS = re.compile(r"<\w+(?:\s+extends\b[^>]*|,)*,?>\s*\(")
_JS_VALUE_WORDS = set("return typeof case in of delete void throw new else do instanceof yield await default".split())


def _js_slow(text: str, markup: bool) -> str:
    """lex for files with regular expressions, templates or markup, which only the tokens before them tell apart."""
    out: list[str] = []
    states: list[str] = []  # 't' within a template's hole, '{' within other braces, 'x' within markup's hole
    at, n, value = 0, len(text), False

    def template(at: int) -> int:
        while at < n:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                states.append("t")
                out.append('""+(')
                return at + 2
            else:
                at += 1
        raise Fault("unterminated")

    while at < n:
        m = _JS_TOKEN.match(text, at)
        token = m[0]
        if token.isspace() or token.startswith(("//", "/*")):
            out.append("\n" if "\n" in token else " ")
        elif token == "`":
            depth = len(states)
            at = template(m.end())
            if len(states) == depth:
                out.append('""')
                value = True
            else:
                value = False
            continue
        elif token == "/":
            regex = None if value else _JS_REGEX.match(text, at)
            if regex:
                out.append('""')
                value, at = True, regex.end()
                continue
            if text.startswith("/*", at):
                raise Fault("unterminated")
            out.append(token)
            value = False
        elif token == "<" and markup and not value and _TAG.match(text, at) and not _TYPE_PARAMETERS.match(text, at):
            at = _markup(text, at, out)
            out.append('""')
            value = True
            continue
        elif token[0] in "\"'" and len(token) > 1:
            out.append('""')
            value = True
        elif token in "\"'":
            raise Fault("unterminated")
        elif token == "{":
            states.append("{")
            out.append(token)
            value = False
        elif token == "}":
            if states and states.pop() == "t":
                out.append(")+")
                depth = len(states)
                at = template(m.end())
                if len(states) == depth:
                    out.append('""')
                    value = True
                continue
            out.append(token)
            value = False
        else:
            out.append(token)
            value = token in (")", "]") or ((token[0].isalnum() or token[0] in "_$" or token[0] > "\x7f") and token not in _JS_VALUE_WORDS) or token in ("++", "--")
        at = m.end()
    return "".join(out)


def _markup(text: str, at: int, out: list[str]) -> int:
    """The end of the markup element that starts at; holes go through the stack of the code around."""
    n, open_tags = len(text), []
    tag = re.compile(r"<(/?)([\w.:-]*)")
    while at < n:
        if text[at] == "<":
            m = tag.match(text, at)
            at = m.end()
            closing, name = bool(m[1]), m[2]
            while at < n and text[at] != ">":
                if text[at] in "\"'":
                    end = text.find(text[at], at + 1)
                    if end < 0:
                        raise Fault("unterminated")
                    at = end + 1
                elif text[at] == "{":
                    at = _hole(text, at, out)
                elif text.startswith("/>", at):
                    break
                elif text[at] in "<!;":
                    raise Fault("foreign")
                else:
                    at += 1
            if at >= n:
                raise Fault("premature_end")
            if text.startswith("/>", at):
                at += 2
            else:
                at += 1
                if closing:
                    if not open_tags or open_tags.pop() != name:
                        raise Fault("unbalanced")
                else:
                    open_tags.append(name)
            if not open_tags:
                return at
        elif text[at] == "{":
            at = _hole(text, at, out)
        elif text[at] in "}>":
            raise Fault("unbalanced")
        else:
            at += 1
    raise Fault("premature_end")


def _hole(text: str, at: int, out: list[str]) -> int:
    """The end of {...} within markup; its code is judged by itself."""
    depth, i = 0, at
    token = re.compile(_DQ + "|" + _SQ + r"|`(?:[^`\\]|\\[\s\S])*`|/\*[\s\S]*?\*/|//[^\n]*|[{}]|.|\n")
    for m in token.finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0:
                i = m.end()
                blocks(_js_slow(text[at + 1 : i - 1], True))
                return i
    raise Fault("premature_end")


_JS_END = re.compile(r"(?:[=+*/%&|^,.?:(\[<~-]|=>|\b(?:const|let|var|function|class|import|export|extends|implements|return\s+new|new|typeof|async|interface|type|from|default|as))\s*\Z")
_JS_FOREIGN = re.compile(r"\n[ \t]*(?:<[!?/\w]|\#(?![\w!])|\#include|\*[ \t]|namespace\s+[\w.]+;|def\s+\w+[^\n]*:$|class\s+\w+(?:\(\w*\))?:|from\s+\S+\s+import\b|if\s[^(\n][^\n]*:$|@\w+[^\n]*\n\s*def\b|func\s*\(|[a-z]\w*!\(|\w+\s*:=)")
_JS_ARROW = re.compile(r"->\s*[\w<>\[\]]+\s*[{;:]")


_JS_VALUE_END = re.compile(r"[\w$)\]}\"'`\x80-\uffff]")


def _starts_regex(text: str, at: int) -> bool:
    """Whether a slash may begin a regular expression: no value stands before it, whatever blanks lie between."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    if not end or not _JS_VALUE_END.match(text[end - 1]):
        return text[end - 1 : end] not in ("<", "/", "*") or text[end - 2 : end] == "*/"
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_$"):
        start -= 1
    if text[start:end] in _JS_VALUE_WORDS or text[end - 1] == "}":
        return True
    return "\n" in text[end:at] and "//" in text[text.rfind("\n", 0, end) + 1 : end]  # a comment may stand between


def _js(text: str, path_end: str) -> str:
    slow = "`" in text or any(_starts_regex(text, m.start()) for m in _JS_SLASH.finditer(text)) or (path_end in ("tsx", "jsx", "js", "mjs") and "<" in text and re.search(r"</|/>", text))
    body = _js_slow(text, path_end not in ("ts",)) if slow else lex(text, "TypeScript")
    return body


def _javascript(body: str) -> None:
    balance(body)
    if any(a not in _JS_FIRST and b not in _JS_SECOND for a, b in set(_JS_PAIR.findall(body))) or _JS_FOREIGN.search("\n" + body) or ("->" in body and _JS_ARROW.search(body)) or "::" in body:
        raise Fault("foreign")
    if re.match(r'\s*\{\s*""\s*:', body):
        raise Fault("foreign")  # an object cannot stand as a statement
    if _JS_END.search(" ".join(body.rsplit(None, 3)[-3:])):
        raise Fault("premature_end")
    end = flat(body[body.rfind("}", 0, len(body.rstrip()) - 1) + 1 :]) if body.count("{") else body
    if re.search(r"(?:\b(?:import\s*(?:type\s*)?(?:\{\}|\*\s*as\s+\w+|\w+)\s*(?:from)?|class\s+\w+(?:\s+(?:extends|implements)\s+[\w.<>, ]+)?|interface\s+\w+(?:\s+extends\s+[\w.<>, ]+)?|function\s*\*?\s*\w+|export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:class|function)[^{}]*)|@\w+(?:\(\))?)\s*\Z", end) and not re.search(r"import\s+\w+\s*=", end):
        raise Fault("premature_end")


# --------------------------------------------------------------------------- the whole


def fault(content: bytes | None, language: str | None, path: str | None = None) -> str | None:
    """The first fault found in a file, '' if there is none, None if that cannot be known."""
    if content is None or language not in LEXERS:
        return None
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "encoding"
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        if language == "PHP":
            _php(text)
            return ""
        if language in ("Cpp", "CSharp") and "#" in text:
            body = lex(text, language)
            allowed = _CPP_DIRECTIVE if language == "Cpp" else _CS_DIRECTIVE
            if any(not allowed.match(x) for x in _DIRECTIVES.findall(body)):
                raise Fault("foreign")
            body = _DIRECTIVES.sub("", body)
        elif language == "TypeScript":
            body = _js(text, (path or "").rpartition(".")[2])
        else:
            body = lex(text, language)
        if ("=======" in body or "<<<<<<<" in body or ">>>>>>>" in body or "|||||||" in body) and _CONFLICT.search(body):
            raise Fault("conflict")
        if not body.strip():
            if language == "Go":
                raise Fault("premature_end")
            return ""
        if language == "TypeScript":
            _javascript(body)
        elif language == "Ruby":
            _ruby(body)
        elif language in BODIES and BODIES[language].search(body):
            raise Fault("unbalanced" if not _balanced(body) else "foreign")
        elif language in HEADS:
            _declared(body, blocks(body), language)
        else:
            balance(body)
            if language == "Go":
                _go(body)
            elif language == "Cpp":
                _cpp(body)
            elif language == "Python":
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(text)
            else:
                _semicolons(body, language)
        return ""
    except Fault as e:
        return str(e)
    except (SyntaxError, ValueError, MemoryError, RecursionError):  # lexer and stack found nothing
        return "python_parser"


@F.pandas_udf(T.StringType())
def _fault(content: pd.Series, language: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([fault(c, x, p) for c, x, p in zip(content, language, path)], dtype=object)


def syntax_fault(content: Column, language: Column, path: Column) -> Column:
    """One of FAULTS, '' for a file that parses, null where that is unknown."""
    return _fault(content, language, F.substring_index(path, "/", -1))


def judged(files: DataFrame) -> DataFrame:
    """files (file_id, repo, path, language, content) -> (file_id, repo, language, fault)."""
    return spread(files.select("file_id", "repo", "language", "content", "path")).select("file_id", "repo", "language", syntax_fault(F.col("content"), F.col("language"), F.col("path")).alias("fault"))


def unparsable(files: DataFrame) -> DataFrame:
    """(file_id) of each file that a parser of its language would reject."""
    return judged(files).where("fault <> ''").select("file_id")


def report(files: DataFrame) -> DataFrame:
    """(repo, language, n_files, n_broken, broken_rate and a count per fault); files of unknown state count as whole."""
    each = [F.count_if(F.col("fault") == x).alias(x) for x in FAULTS]
    broken = F.count_if(F.coalesce(F.col("fault"), F.lit("")) != "")
    return judged(files).groupBy("repo", "language").agg(F.count("*").alias("n_files"), broken.alias("n_broken"), F.round(broken / F.count("*"), 6).alias("broken_rate"), *each)
