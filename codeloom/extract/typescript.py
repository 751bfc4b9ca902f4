"""TypeScript and JavaScript: interfaces, classes, functions, aliases, imports, exports, services, schemas."""

from __future__ import annotations

import re

from codeloom.extract.text import Source, decorator_arg, field, parameter, prop, split_top, strip_quotes, symbol

W = r"[A-Za-z_$\u0080-￿][\w$]*"
_TYPE = re.compile(rf"\b(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?P<abstract>abstract\s+)?(?P<kw>interface|class)\s+(?P<name>{W})\s*(?P<generics><[^{{}}()]*?>)?(?=\s|\{{)")
_FUNCTION = re.compile(rf"\b(?P<async>async\s+)?function\s*(?P<star>\*)?\s*(?P<name>{W})\s*(?=[<(])")
_ARROW = re.compile(rf"\b(?:const|let|var)\s+(?P<name>{W})\s*(?::[^=]+?(?:=>[^=]*?)*)?=\s*(?P<async>async\b\s*)?(?:(?P<fn>function\b\s*\*?\s*{W}?\s*)|(?=<|\(|{W}\s*=>))")
_SINGLE = re.compile(rf"({W})\s*=>")
_ALIAS = re.compile(rf"\btype\s+(?P<name>{W})\s*(?P<generics><[^=]*?>)?\s*=\s*")
_IMPORT = re.compile(r"^[ \t]*import\b(?!\s*\()(?P<clause>[^;\"']*?)(?:\bfrom\b\s*)?[\"'](?P<source>[^\n]*?)[\"']", re.M)
_EXPORT = re.compile(r"^[ \t]*export\b", re.M)
_MEMBER = re.compile(rf"(?P<mods>(?:(?:public|private|protected|static|async|abstract|readonly|override|declare|get|set|accessor)\s++)*)(?P<star>\*\s*+)?(?P<name>\#?{W}|\[[^\]]*\]|\"[^\"]*\"|'[^']*')\s*+(?P<opt>[?!])?\s*+(?:<[^()]*>\s*+)?(?P<next>[(:=;]|$)")
_SCHEMA = re.compile(rf"\b(?:const|let|var)\s+(?P<name>{W})\s*(?::[^=\n]+)?=\s*(?P<call>(?:Schema|S)\.Struct|z\.object|z\.enum|pgTable|mysqlTable|sqliteTable)\s*(?=\()")
_ALIAS_STOP = re.compile(r"[({\[;\n]")
_TYPE_NEXT = re.compile(r"\s*(?:extends|keyof|is|in|as)\b")
_TYPE_WORDS = ("keyof", "typeof", "extends", "infer", "readonly", "is", "in", "as", "unique", "asserts")
_ARROW_STOP = re.compile(r"[({\[]|=>?|[;)}\]]")
# What decorators and calls stand for.
SERVICES = {"Controller": "http_controller", "Injectable": "microservice", "Service": "microservice", "Resolver": "graphql_resolver", "Middleware": "middleware", "Processor": "worker", "Process": "worker"}
VERBS = {"Get": "GET", "Post": "POST", "Put": "PUT", "Patch": "PATCH", "Delete": "DELETE", "Head": "HEAD", "Options": "OPTIONS"}
FRAMEWORKS = {
    "Schema.Struct": ("effect-schema", "validation_schema"), "S.Struct": ("effect-schema", "validation_schema"), "z.object": ("zod", "validation_schema"),
    "z.enum": ("zod", "validation_schema"), "pgTable": ("drizzle", "orm_model"), "mysqlTable": ("drizzle", "orm_model"), "sqliteTable": ("drizzle", "orm_model"),
}


def params(text: str) -> list[dict]:
    out = []
    for p in split_top(text):
        p = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|readonly|override)\s+)*", "", p)
        rest = p.startswith("...")
        m = re.match(rf"(?:\.\.\.)?\s*(\{{[\s\S]*?\}}|\[[\s\S]*?\]|{W})\s*(\?)?\s*(?::([\s\S]*?))?(?:=(?!>)([\s\S]*))?$", p)
        if m:
            out.append(parameter(m[1], (m[3] or "").strip(), bool(m[2]) or m[4] is not None or rest, m[4] is not None, rest))
    return out


def _returns(src: Source, close: int, end: int) -> str | None:
    m = re.match(r"\s*:\s*", src.code[close + 1 : end])
    if not m:
        return None
    at = close + 1 + m.end()
    tail = src.code[at:end]
    stop = re.search(r"=>|\{(?!\s*+\w+\s*+[?:])|;|$", tail)
    return src.text(at, at + (stop.start() if stop else len(tail))) or None


def _decorators(src: Source, at: int) -> list[str]:
    """Texts, without the @, of the decorators right before a place; export words may stand in between."""
    out = []
    while True:
        word, start = src.word_before(at)
        if word in ("export", "default", "declare"):
            at = start
        elif found := src.annotation_before(at):
            out.append(src.text(found[0] + 1, found[1]))
            at = found[0]
        else:
            return out[::-1]


def _exported(src: Source, at: int) -> bool:
    word, start = src.word_before(at)
    while word in ("default", "declare"):
        word, start = src.word_before(start)
    return word == "export"


def _members(src: Source, body: tuple[int, int]) -> tuple[list[tuple], list[tuple]]:
    """(methods, properties) as tuples of match, start, end and decorators."""
    methods, props, waiting = [], [], []
    for start, end, block in src.members(body[0] + 1, body[1], True):
        at = start
        while m := re.match(rf"@{W}(?:\.{W})*\s*", src.code[at:end]):
            stop = at + m.end()
            if src.code[stop : stop + 1] == "(":
                stop = src.close[stop] + 1
            waiting.append(src.text(at + 1, stop))
            at = stop + len(src.code[stop:end]) - len(src.code[stop:end].lstrip())
        m = _MEMBER.match(src.code, at, end)
        if not m or at >= end:
            continue
        (methods if m["next"] == "(" else props).append((m, at, end, block, waiting))
        waiting = []
    return methods, props


def _visibility(mods: str) -> str:
    return next((v for v in ("private", "protected", "public") if v in mods.split()), "public")


def _method(src: Source, m: re.Match, at: int, end: int, decorators: list[str]) -> dict:
    opened = m.end() - 1
    close = src.close[opened]
    mods = m["mods"] or ""
    return {
        "name": m["name"], "file": src.path, "span": src.span(at, end), "visibility": _visibility(mods), "is_async": "async" in mods.split(), "is_static": "static" in mods.split(),
        "is_generator": bool(m["star"]), "parameters": params(src.raw[opened + 1 : close]), "return_type": _returns(src, close, end), "decorators": decorators, "owner": None, "implements": None,
    }


def _heritage(text: str) -> tuple[list[str], list[str]]:
    a = re.search(r"\bextends\b([\s\S]*?)(?=\bimplements\b|$)", text)
    b = re.search(r"\bimplements\b([\s\S]*)", text)
    return split_top(a[1]) if a else [], split_top(b[1]) if b else []


def parse_fields(text: str) -> list[dict]:
    """Fields of an object literal: name: expression, where calls in the expression say what holds for the field."""
    out = []
    for part in split_top(text.strip().lstrip("({").rstrip(")}")):
        name, colon, kind = part.partition(":")
        if not colon:
            continue
        kind = kind.strip()
        marks = [x for x in ("unique", "nullable", "default") if f".{x}(" in kind]
        out.append(field(strip_quotes(name.strip()), kind, ".optional()" in kind or ".nullable()" in kind, "primaryKey" in kind, marks))
    return out


def scan(src: Source) -> dict[str, list]:
    code, out = src.code, {k: [] for k in ("interfaces", "classes", "functions", "type_aliases", "imports", "exports", "services", "schemas")}
    for m in _TYPE.finditer(code):
        body = src.body(m.end(), ";")
        if not body:
            continue
        start, end = m.start(), min(body[1] + 1, len(code))
        generics = split_top((m["generics"] or "")[1:-1])
        visibility = "public" if m[0].startswith("export") else "private"
        extends, implements = _heritage(src.raw[m.end() : body[0]])
        methods, props = _members(src, body)
        decorators = _decorators(src, start)
        properties = [
            prop(x["name"], (_annotation(src, x, e)), x["opt"] == "?", "readonly" in (x["mods"] or ""), "public" if m["kw"] == "interface" else _visibility(x["mods"] or "")) for x, _, e, _, _ in props
        ]
        if m["kw"] == "interface":
            signatures = [
                {"name": x["name"], "span": src.span(a, e), "is_async": False, "parameters": params(src.raw[x.end() : src.close[x.end() - 1]]), "return_type": _returns(src, src.close[x.end() - 1], e), "has_default": False}
                for x, a, e, _, _ in methods
            ]
            out["interfaces"].append({"name": m["name"], "file": src.path, "span": src.span(start, end), "visibility": visibility, "generics": generics, "extends": extends, "methods": signatures, "properties": properties, "language_kind": "interface", "decorators": []})
            continue
        whole = [_method(src, x, a, e, d) for x, a, e, block, d in methods if block and x["name"] != "constructor"]
        out["classes"].append({"name": m["name"], "file": src.path, "span": src.span(start, end), "visibility": visibility, "generics": generics, "extends": extends[0] if extends else None, "implements": implements, "methods": whole, "properties": properties, "is_abstract": bool(m["abstract"]), "decorators": decorators})
        kind = next((SERVICES[n] for d in decorators if (n := d.partition("(")[0].strip()) in SERVICES), None)
        if kind:
            made = next((x for x, *_ in methods if x["name"] == "constructor"), None)
            deps = [p["type_annotation"] for p in params(src.raw[made.end() : src.close[made.end() - 1]]) if p["type_annotation"]] if made else []
            routes = [{"method": VERBS[n], "path": decorator_arg(d), "handler": x["name"]} for x in whole for d in x["decorators"] if (n := d.partition("(")[0].strip()) in VERBS]
            out["services"].append({"name": m["name"], "file": src.path, "span": src.span(start, end), "kind": kind, "methods": [x | {"owner": m["name"]} for x in whole], "dependencies": deps, "decorators": decorators, "routes": routes})
    _functions(src, out)
    for m in _ALIAS.finditer(code):
        end = _alias_end(src, m.end())
        exported = _exported(src, m.start())
        out["type_aliases"].append({"name": m["name"], "file": src.path, "span": src.span(m.start(), end), "target": src.text(m.end(), end), "generics": split_top((m["generics"] or "")[1:-1]), "visibility": "public" if exported else "private"})
    _imports(src, out)
    for m in _SCHEMA.finditer(code):
        framework, kind = FRAMEWORKS[m["call"]]
        close = src.close[m.end()]
        args = src.raw[m.end() + 1 : close]
        brace = code.find("{", m.end(), close)
        fields = parse_fields(src.raw[brace : src.close[brace] + 1]) if brace >= 0 else []
        named = re.match(r"\s*[\"'`]([^\"'`]*)", args) if framework == "drizzle" else None
        exported = _exported(src, m.start())
        out["schemas"].append({"name": m["name"], "file": src.path, "span": src.span(m.start(), close + 1), "kind": kind, "fields": fields, "source_framework": framework, "table_name": named[1] if named else None, "derives": [], "visibility": "public" if exported else "private"})
    return out


def _alias_end(src: Source, at: int) -> int:
    """Where the target of an alias ends: at a semicolon, or at a line end over which no operator goes on."""
    code, i = src.code, at
    while m := _ALIAS_STOP.search(code, i):
        i = m.start()
        if m[0] == ";":
            return i
        if m[0] != "\n":
            i = src.close[i]
        elif src.solid(i) > at and code[src.solid(i) - 1] not in "=|&,:?<([{" and src.next(i) not in ("|", "&", "?", ":", ".", "=", ")", "]", "}", ">", ",") and src.word_before(i)[0] not in _TYPE_WORDS and not _TYPE_NEXT.match(code, i):
            return i
        i += 1
    return len(code)


def _annotation(src: Source, m: re.Match, end: int) -> str | None:
    if m["next"] != ":":
        return None
    equal = re.search(r"(?<![=!<>])=(?![=>])", src.code[m.end() : end])
    return src.text(m.end(), m.end() + equal.start() if equal else end) or None


def _arrow(src: Source, at: int) -> int:
    """The place after the => that follows the parameters that end at a place, with a return type in between or not; else -1."""
    code = src.code
    i = src.skip(at)
    if code[i : i + 1] != ":":
        return i + 2 if code.startswith("=>", i) else -1
    while m := _ARROW_STOP.search(code, i):
        if m[0] == "=>":
            return m.end()
        if m[0] not in "({[":
            return -1
        i = src.close[m.start()] + 1
    return -1


def _functions(src: Source, out: dict[str, list]) -> None:
    code = src.code
    for m in [*_FUNCTION.finditer(code), *_ARROW.finditer(code)]:
        arrow = m.re is _ARROW
        if not arrow and code[src.solid(m.start()) - 1 : src.solid(m.start())] == "=":
            continue  # bound to a variable, found there
        plain = arrow and not m["fn"]
        single = plain and _SINGLE.match(code, m.end())
        after = -1
        if single:
            close, given, after = single.end(1) - 1, [parameter(single[1])], single.end()
        else:
            opened = src.skip(src.angles(src.skip(m.end())))
            if code[opened : opened + 1] != "(":
                continue
            close, given = src.close[opened], params(src.raw[opened + 1 : src.close[opened]])
            if plain and (after := _arrow(src, close + 1)) < 0:
                continue
        if plain:
            first = src.skip(after)
            body = (first, src.close[first]) if code[first : first + 1] == "{" else None
            end = min(body[1] + 1, len(code)) if body else _expression_end(src, first)
        else:
            body = src.body(close + 1, ";")
            line = code.find("\n", close)
            end = min(body[1] + 1, len(code)) if body else (line if line >= 0 else len(code))
        star = bool(m["fn"] and "*" in m["fn"]) if arrow else bool(m["star"])
        returns = None if single else src.text(src.skip(close + 1) + 1, after - 2) if plain and code[src.skip(close + 1)] == ":" else None if plain else _returns(src, close, body[0] if body else end)
        out["functions"].append({"name": m["name"], "file": src.path, "span": src.span(m.start(), end), "visibility": "public" if _exported(src, m.start()) else "private", "is_async": bool(m["async"]), "is_generator": star, "parameters": given, "return_type": returns or None, "decorators": []})
    out["functions"].sort(key=lambda f: f["span"]["byte_range"]["start"])


def _expression_end(src: Source, at: int) -> int:
    """The end of an expression: its semicolon, or the line end after it."""
    while m := _ALIAS_STOP.search(src.code, at):
        if m[0] in ";\n":
            return m.start()
        at = src.close[m.start()] + 1
    return len(src.code)


_FROM = re.compile(r"\s*(?:type\s+)?(?:\*(?:\s*as\s+\w+)?|\{[^}]*\})\s*from\s*[\"']([^\"'\n]*)")
_STAR = re.compile(r"\s*\*")
_BRACES = re.compile(r"\s*(?:type\s+)?\{([^}]*)\}")
_DEFAULT = re.compile(rf"\s*default\b\s*(?:abstract\s+)?(?:(?:async\s+)?function\s*\*?|class)?\s*({W})?")
_DECLARED = re.compile(rf"\s*(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|const\s+enum|enum|const|let|var|namespace)\s+({W})")


def _imports(src: Source, out: dict[str, list]) -> None:
    code = src.code
    for m in _IMPORT.finditer(code):
        clause, symbols = re.sub(r"^\s*type\b(?!\s*from)", "", m["clause"]).strip(), []
        wild = False
        for part in split_top(clause):
            if part.startswith("{"):
                for one in split_top(part[1:-1]):
                    name, _, alias = re.sub(r"\s+", " ", re.sub(r"^type\s+", "", one)).partition(" as ")
                    symbols.append(symbol(name.strip(), alias.strip() or None))
            elif star := re.match(r"\*\s*as\s+(\S+)", part):
                wild = True
                symbols.append(symbol(star[1], None, False, True))
            elif part:
                symbols.append(symbol(part, None, True))
        out["imports"].append({"source": src.raw[slice(*m.span("source"))], "symbols": symbols, "is_wildcard": wild, "span": src.span(m.start(), m.end())})
    for m in _EXPORT.finditer(code):
        origin = _FROM.match(code, m.end())
        source = src.raw[slice(*origin.span(1))] if origin else None
        line = src.raw.find("\n", m.end())
        at = src.span(m.start(), line if line >= 0 else len(src.raw))
        names: list[tuple[str, str]] = []
        if _STAR.match(code, m.end()):
            names = [("*", "re_export")]
        elif braces := _BRACES.match(code, m.end()):
            names = [(re.split(r"\s+as\s+", x)[-1].strip(), "re_export" if source else "named") for x in split_top(braces[1])]
        elif one := _DEFAULT.match(code, m.end()):
            names = [(one[1] or "default", "default")]
        elif one := _DECLARED.match(code, m.end()):
            names = [(one[1], "named")]
        out["exports"] += [{"name": n, "kind": k, "source": source, "span": at} for n, k in names]
