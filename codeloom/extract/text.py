"""What the scanners share: texts with comments and literals blanked in place, delimiters that belong together, spans."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"?'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'?"
_C = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_TICK = r"`(?:[^`\\]|\\[\s\S])*`?"
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
_TRIPLE = r'"""[\s\S]*?(?:"""|\Z)'
#: language -> (comments, literals)
_SKIP = {
    "TypeScript": (_C, f"{_DQ}|{_SQ}|{_TICK}"),
    "Rust": (_C, rf'r(?P<h>#*)"[\s\S]*?"(?P=h)|"(?:[^"\\]|\\[\s\S])*"?|{_CHAR}'),
    "Go": (_C, f"{_DQ}|`[^`]*`?|{_CHAR}"),
    "Java": (_C, f"{_TRIPLE}|{_DQ}|{_CHAR}"),
    "Kotlin": (_C, f"{_TRIPLE}|{_DQ}|{_CHAR}"),
    "Scala": (_C, f"{_TRIPLE}|{_DQ}|{_CHAR}"),
    "CSharp": (_C, rf'{_TRIPLE}|@"(?:[^"]|"")*"?|{_DQ}|{_CHAR}'),
    "Swift": (_C, f"{_TRIPLE}|{_DQ}"),
    "Cpp": (_C, rf'R"(?P<d>[^(\s]*)\([\s\S]*?\)(?P=d)"|{_DQ}|{_CHAR}'),
    "PHP": (rf"{_C}|\#(?!\[)[^\n]*", r'"(?:[^"\\]|\\[\s\S])*"?' + "|" + r"'(?:[^'\\]|\\[\s\S])*'?"),
    "Ruby": (r"^=begin\b[\s\S]*?(?:^=end[^\n]*|\Z)|\#[^\n]*", f"{_DQ}|{_SQ}"),
    "Python": (r"\#[^\n]*", rf"{_TRIPLE}|'''[\s\S]*?(?:'''|\Z)|{_DQ}|{_SQ}"),
}
_SKIPPERS = {k: re.compile(f"(?P<c>{c})|(?P<s>{s})", re.M) for k, (c, s) in _SKIP.items()}
#: Languages whose block comments may hold others.
NESTING = {"Rust", "Kotlin", "Scala", "Swift"}
_COMMENT_END = re.compile(r"/\*|\*/")
_NESTED_COMMENT = re.compile(r"/\*(?:(?!\*/)[\s\S])*?/\*")
_NOT_NEWLINE = re.compile(r"[^\n]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_DELIMITER = re.compile(r"[(){}\[\]]")
_SOLID = re.compile(r"\S+")
_NEXT = re.compile(r"\S")
_ANGLE = re.compile(r"[<({\[;]|(?<![-=])>")
_BLOCK_OR_END, _BLOCK_OR_LINE = re.compile(r"[({\[;}]"), re.compile(r"[({\[;}\n]")
_PIECE_END, _LINE_END = re.compile(r"[({\[;]"), re.compile(r"[({\[;\n]")
_MARK = re.compile(r"\s*@\w+(?:\.\w+)*\s*")
#: Characters between two places whose lengths in bytes are kept.
_STEP = 4096


def comment_end(text: str, at: int) -> int:
    """The end of the block comment that starts at a place, comments within it taken by depth; -1 if it has none."""
    depth = 0
    for m in _COMMENT_END.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return -1


class Source:
    """A source text: raw, and code of equal length with comments as blanks and the inside of literals as blanks."""

    def __init__(self, content: bytes, language: str, path: str) -> None:
        self.path, self.language = path, language
        self.raw = content.decode("utf-8", "replace")
        #: The same with any line end as a line feed, place by place.
        self.lined = self.raw.replace("\r", "\n") if "\r" in self.raw else self.raw
        if language in NESTING and _NESTED_COMMENT.search(self.lined):
            self.code = self._blank_nested()
        else:
            self.code = _SKIPPERS[language].sub(self._blank, self.lined)

    @staticmethod
    def _blank(m: re.Match) -> str:
        s = m[0]
        if m.lastgroup == "c" or len(s) < 3:
            return _NOT_NEWLINE.sub(" ", s) if m.lastgroup == "c" else s
        return s[0] + _NOT_NEWLINE.sub(" ", s[1:-1]) + s[-1]

    def _blank_nested(self) -> str:
        out, at, find = [], 0, _SKIPPERS[self.language].search
        while m := find(self.lined, at):
            out.append(self.lined[at : m.start()])
            at = m.end()
            if m[0].startswith("/*"):
                end = comment_end(self.lined, m.start())
                at = end if end >= 0 else len(self.lined)
                out.append(_NOT_NEWLINE.sub(" ", self.lined[m.start() : at]))
            else:
                out.append(self._blank(m))
        return "".join([*out, self.lined[at:]])

    @cached_property
    def close(self) -> dict[int, int]:
        """Place of each opening delimiter -> place of the one that closes it; open ends go to the end of the text."""
        out: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        waiting = {"(": 0, "[": 0, "{": 0}
        for m in _DELIMITER.finditer(self.code):
            c = m[0]
            if c in waiting:
                stack.append((c, m.start()))
                waiting[c] += 1
            elif waiting[_PAIRS[c]]:
                while True:  # what stands between and never closes is dropped
                    kind, at = stack.pop()
                    waiting[kind] -= 1
                    if kind == _PAIRS[c]:
                        out[at] = m.start()
                        break
        for _, at in stack:
            out[at] = len(self.code)
        return out

    @cached_property
    def opener(self) -> dict[int, int]:
        return {b: a for a, b in self.close.items()}

    @cached_property
    def _braces(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Starts, ends and enclosing block of each brace block by start, and all ends in order."""
        blocks = sorted((a, b) for a, b in self.close.items() if self.code[a] == "{")
        up: list[int] = []
        stack: list[int] = []
        for i, (a, _) in enumerate(blocks):
            while stack and blocks[stack[-1]][1] < a:
                stack.pop()
            up.append(stack[-1] if stack else -1)
            stack.append(i)
        return [a for a, _ in blocks], [b for _, b in blocks], up, sorted(b for _, b in blocks)

    def depth(self, at: int) -> int:
        """Number of brace blocks around a place."""
        starts, _, _, ends = self._braces
        return bisect_left(starts, at) - bisect_right(ends, at)

    def around(self, at: int) -> Iterator[tuple[int, int]]:
        """The brace blocks around a place, the innermost first."""
        starts, ends, up, _ = self._braces
        i = bisect_left(starts, at) - 1
        while i >= 0:
            if ends[i] > at:
                yield starts[i], ends[i]
            i = up[i]

    @cached_property
    def _solid(self) -> list[int]:
        return [m.end() for m in _SOLID.finditer(self.code)]

    def solid(self, at: int) -> int:
        """The end of the code before a place, whatever blanks and comments stand in between."""
        if at and not self.code[at - 1].isspace():
            return at
        i = bisect_right(self._solid, at)
        return self._solid[i - 1] if i else 0

    def next(self, at: int) -> str:
        """The first character of code from a place on."""
        m = _NEXT.search(self.code, at)
        return m[0] if m else ""

    def word_before(self, at: int) -> tuple[str, int]:
        """(word, its start) right before a place; the word may be empty."""
        start = end = self.solid(at)
        while start and (self.code[start - 1].isalnum() or self.code[start - 1] in "_$"):
            start -= 1
        return self.code[start:end], start

    def annotation_before(self, at: int) -> tuple[int, int] | None:
        """(start, end) of the @name or @name(...) right before a place."""
        end = head = self.solid(at)
        if end and self.code[end - 1] == ")":
            opened = self.opener.get(end - 1)
            if opened is None:
                return None
            head = self.solid(opened)
        start = head
        while start and (self.code[start - 1].isalnum() or self.code[start - 1] in "_$.:"):
            start -= 1
        return (start - 1, end) if 0 < start < head and self.code[start - 1] == "@" else None

    def angles(self, at: int) -> int:
        """The end of the type parameters in <> that start at a place; the place itself if there are none."""
        if self.code[at : at + 1] != "<":
            return at
        depth, i = 0, at
        while m := _ANGLE.search(self.code, i):
            c, i = m[0], m.start()
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif c == ";":
                return at
            else:
                i = self.close[i]
            i += 1
        return at

    def skip(self, at: int) -> int:
        """The place of the first code from a place on, or the end of the text."""
        m = _NEXT.search(self.code, at)
        return m.start() if m else len(self.code)

    @cached_property
    def _starts(self) -> list[int]:
        return [0] + [m.end() for m in re.finditer("\n", self.raw)]

    @cached_property
    def _ascii(self) -> bool:
        return self.raw.isascii()

    def line(self, at: int) -> int:
        return bisect_right(self._starts, at) - 1

    @cached_property
    def _bytes_at(self) -> list[int]:
        out = [0]
        for i in range(0, len(self.raw), _STEP):
            out.append(out[-1] + len(self.raw[i : i + _STEP].encode()))
        return out

    def _bytes(self, at: int) -> int:
        return at if self._ascii else self._bytes_at[at // _STEP] + len(self.raw[at - at % _STEP : at].encode())

    def span(self, start: int, end: int) -> dict:
        """Rows from 0, columns and range in bytes."""
        a, b = self.line(start), self.line(end)
        first, last = self._bytes(start), self._bytes(end)
        return {
            "start_line": a, "start_col": first - self._bytes(self._starts[a]), "end_line": b, "end_col": last - self._bytes(self._starts[b]),
            "byte_range": {"start": first, "end": last},
        }

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].strip()

    def body(self, at: int, stop: str = ";") -> tuple[int, int] | None:
        """The first brace block from at on, unless a stop character comes first outside other delimiters."""
        find = (_BLOCK_OR_LINE if "\n" in stop else _BLOCK_OR_END).search
        while m := find(self.code, at):
            if m[0] == "{":
                return m.start(), self.close[m.start()]
            if m[0] not in "([":
                return None
            at = self.close[m.start()] + 1
        return None

    def members(self, lo: int, hi: int, lines: bool) -> list[tuple[int, int, tuple[int, int] | None]]:
        """(start, end, block) of each member between lo and hi; with lines, line ends end members too."""
        out: list[tuple[int, int, tuple[int, int] | None]] = []
        i = start = lo
        find = (_LINE_END if lines else _PIECE_END).search

        def put(end: int, block: tuple[int, int] | None) -> None:
            a = self.skip(start)
            if a < end:
                out.append((a, end, block))

        while m := find(self.code, i, hi):
            c, i = m[0], m.start()
            if c in "([":
                i = min(self.close[i], hi)
            elif c == "{":
                e = min(self.close[i], hi)
                if not self._value(start, i, lines):
                    put(min(e + 1, hi), (i, e))
                    start = e + 1
                i = e
            elif c == ";" or (self.solid(i) > start and not self._goes_on(start, i)):
                put(i, None)
                start = i + 1
            i += 1
        put(hi, None)
        return out

    def _value(self, start: int, at: int, lines: bool) -> bool:
        """Whether the block at a place is a value of the member from start on."""
        end = self.solid(at)
        if end <= start or not (self.code[end - 1] == "=" or self.code[end - 2 : end] == "=>"):
            return False
        line = max(start, self.code.rfind("\n", start, end) + 1)
        return not (lines and self.code[end - 1] == "=" and re.search(r"\bdef\b", self.code[line:end]))

    def _goes_on(self, start: int, at: int) -> bool:
        """Whether the member from start on goes on after the line end at a place."""
        end = self.solid(at)
        if self.code[end - 1] in ",=:.&|+({[" or self.code[end - 2 : end] in ("=>", "->") or self.next(at + 1) in ("{", ".", "=", "?", ":", "&", "|"):
            return True
        stop = start
        while m := _MARK.match(self.code, stop, end):  # annotations alone
            stop = self.close[m.end()] + 1 if self.code[m.end() : m.end() + 1] == "(" else m.end()
        return stop > start and self.solid(min(stop, end)) == end or bool(re.match(r"\s*\[\w+\]$", self.code[start:end]))


_SPLITTERS = {d: re.compile(rf"[()\[\]{{}}<>{d}]") for d in ",+"}


def split_top(text: str, delimiter: str = ",") -> list[str]:
    """Parts of a text between delimiters that stand outside all brackets; quotes are not looked at."""
    out, depth, at = [], 0, 0
    for m in _SPLITTERS[delimiter].finditer(text):
        c = m[0]
        if c in "([{<":
            depth += 1
        elif c == delimiter:
            if depth <= 0:
                out.append(text[at : m.start()])
                at = m.end()
        elif c != ">" or m.start() == 0 or text[m.start() - 1] not in "-=":
            depth -= 1
    out.append(text[at:])
    return [x for x in map(str.strip, out) if x]


def strip_quotes(text: str) -> str:
    return text.strip("\"'`")


def decorator_arg(text: str) -> str:
    """What stands between the first ( and the last ), trimmed and without quotes; '' without parentheses."""
    a, b = text.find("("), text.rfind(")")
    return strip_quotes(text[a + 1 : b].strip()) if 0 <= a < b else ""


def parameter(name: str, kind: str | None = None, optional: bool = False, default: bool = False, rest: bool = False) -> dict:
    return {"name": name, "type_annotation": kind or None, "is_optional": optional, "has_default": default, "is_rest": rest}


def prop(name: str, kind: str | None, optional: bool = False, readonly: bool = False, visibility: str = "public") -> dict:
    return {"name": name, "type_annotation": kind or None, "is_optional": optional, "is_readonly": readonly, "visibility": visibility}


def field(name: str, kind: str | None, optional: bool = False, key: bool = False, constraints: list[str] | None = None) -> dict:
    return {"name": name, "type_annotation": kind or None, "is_optional": optional, "is_primary_key": key, "constraints": constraints or []}


def symbol(name: str, alias: str | None = None, default: bool = False, namespace: bool = False) -> dict:
    return {"name": name, "alias": alias, "is_default": default, "is_namespace": namespace}
