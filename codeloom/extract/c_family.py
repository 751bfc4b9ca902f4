"""Java, C#, Kotlin, Scala, Swift, C++ and PHP: type declarations with members, by one recogniser and a form per language."""

from __future__ import annotations

import re

from codeloom.extract.text import Source, decorator_arg, field, parameter, prop, split_top, symbol

W = r"[^\W\d]\w*"
# What annotations stand for.
JAVA_SERVICES = {"RestController": "http_controller", "Controller": "http_controller", "Service": "microservice", "Component": "microservice", "Repository": "repository"}
CSHARP_SERVICES = {"ApiController": "http_controller", "Controller": "http_controller", "Service": "microservice", "Repository": "repository"}
SWIFT_SERVICES = {"Service": "microservice", "Controller": "http_controller", "Repository": "repository"}
JAVA_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": "GET"}
CSHARP_VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpPatch": "PATCH", "HttpDelete": "DELETE"}

_MODS = r"(?P<mods>(?:(?:public|private|protected|internal|fileprivate|open|package|static|final|abstract|sealed|non-sealed|partial|readonly|data|enum|annotation|inline|value|inner|companion|override|suspend|virtual|async|case|implicit|lazy|indirect|mutating|class|required|convenience|unsafe|new|extern|file|strictfp|default|native|synchronized|transient|volatile|const|tailrec|operator|infix|external|lateinit|var|weak|unowned)(?:\[\w*\]|\(set\))?\s++)*)"
_KEYWORDS = {
    "Java": "class|interface|@interface|enum|record", "CSharp": "class|interface|struct|enum|record(?:\\s+(?:struct|class))?", "Kotlin": "class|interface|object", "Scala": "class|trait|object",
    "Swift": "class|struct|enum|protocol|extension|actor", "Cpp": "class|struct", "PHP": "class|interface|trait",
}
_TYPES = {k: re.compile(rf"(?<![\w.:@]){_MODS}(?P<kw>{v})\s+(?P<name>{W}(?:\.{W})*)\s*(?P<generics><[^{{}};()]*?>|\[[^\]\n]*\])?(?=[\s{{(:;,]|$)") for k, v in _KEYWORDS.items()}
_PRIMARY = re.compile(r"\s*(?:private\s+|internal\s+|protected\s+|public\s+|@\w+\s+|constructor\s*)*\(")


def _before(src: Source, at: int) -> list[str]:
    """Raw texts of the annotations or attributes right before a place, outermost first."""
    out: list[str] = []
    while True:
        end = src.solid(at)
        if src.language in ("CSharp", "PHP", "Cpp") and end and src.code[end - 1] == "]":
            opened = src.opener.get(end - 1)
            if opened is None:
                return out
            last = src.solid(opened)
            if last and (src.code[last - 1].isalnum() or src.code[last - 1] in "_)=") and "\n" not in src.code[last:opened]:
                return out  # an index or a size
            out.insert(0, src.text(opened, end))
            at = opened - (src.code[opened - 1 : opened] == "#")
            continue
        found = src.annotation_before(at)
        if not found:
            return out
        out.insert(0, src.text(*found))
        at = found[0]


def _template(src: Source, at: int) -> list[str]:
    """Parameters of the template<...> right before a place."""
    end = start = src.solid(at)
    depth = 0
    while start:
        start -= 1
        c = src.code[start]
        depth += (c == ">") - (c == "<")
        if not depth or c in ";{}":
            break
    if end and not depth and src.code[end - 1] == ">" and src.word_before(start)[0] == "template":
        return [re.sub(r"^(?:typename|class)\s+", "", x) for x in split_top(src.code[start + 1 : end - 1])]
    return []


def _names(src: Source, raw: list[str]) -> list[str]:
    if src.language == "Java":
        return [re.match(rf"@({W}(?:\.{W})*)", x)[1] for x in raw]
    if src.language == "CSharp":
        return [y if "(" in y else re.match(r"[\w.]+", y)[0] for x in raw for y in split_top(x[1:-1]) if re.match(r"[\w.]+", y)]
    return [x.lstrip("@") for x in raw]


def _visibility(language: str, mods: str, member: bool = False) -> str:
    words = re.findall(r"[\w-]+", mods)
    table = {"fileprivate": "private", "open": "public" if language == "Swift" else None}
    for w in words:
        v = table.get(w, w)
        if v in ("public", "private", "protected", "internal"):
            return v
    return {"Java": "unknown", "CSharp": "private" if member else "internal", "Swift": "internal", "Kotlin": "public", "Scala": "public", "PHP": "public", "Cpp": "public"}[language]


def _after_name(text: str) -> list[dict]:
    """Parameters written name: Type."""
    out = []
    for p in split_top(text):
        p = re.sub(rf"^(?:@{W}(?:\([^)]*\))?\s*|(?:val|var|implicit|using|vararg|override|private|public|protected|internal|final|noinline|crossinline|inout|borrowing)\s+)*", "", p)
        m = re.match(rf"(?:({W}|_)\s+)?({W})\s*:\s*(?:inout\s+)?([\s\S]*?)(?:=(?!>)([\s\S]*))?$", p)
        if m:
            out.append((m[2], m[3].strip(), m[4] is not None))
    return out


def _before_name(text: str) -> list[tuple[str, str, bool, bool]]:
    """Parameters written Type name: (name, type, has default, rest)."""
    out = []
    for p in split_top(text):
        if p.strip() in ("void", ""):
            continue
        p = re.sub(rf"^(?:@{W}(?:\([^)]*\))?\s*|\[[^\]]*\]\s*|(?:final|ref|out|in|this)\s+)*", "", p)
        rest = "..." in p or bool(re.match(r"params\s", p))
        head, eq, _ = p.partition("=")
        head = re.sub(r"^params\s+", "", head).strip()
        m = re.match(rf"([\s\S]*?[\s*&>\].])({W})\s*(\[[^\]]*\])?$", head)
        if m:
            out.append((m[2], m[1].replace("...", "").strip(), bool(eq), rest))
        else:
            out.append(("..." if head == "..." else "", head, bool(eq), rest))
    return out


def params(language: str, text: str) -> list[dict]:
    if language in ("Kotlin", "Scala"):
        return [parameter(n, t, d, d) for n, t, d in _after_name(text)]
    if language == "Swift":
        return [parameter(n, t) for n, t, _ in _after_name(text)]
    if language == "PHP":
        out = []
        for p in split_top(text):
            m = re.match(rf"(?:\#\[[^\]]*\]\s*)*(?:(?:public|private|protected|readonly)\s+)*([\w\\|?&\s]*?)\s*&?(\.\.\.)?\s*\$({W})\s*(=)?", p)
            if m:
                out.append(parameter(m[3], m[1].strip(), bool(m[4]) or bool(m[2]), bool(m[4]), bool(m[2])))
        return out
    return [parameter(n, t, d and language in ("Cpp", "CSharp"), d, r) for n, t, d, r in _before_name(text)]


# Blanks are matched possessively throughout: a comment is a run of blanks, of any length.
_METHOD = {
    "Java": re.compile(rf"{_MODS}(?:<[^()]*?>\s*+)?(?P<type>(?:(?:\w++|[.<>\[\]?,&])\s*+)+?(?<=\s))?(?P<name>{W})\s*+(?=\()"),
    "CSharp": re.compile(rf"{_MODS}(?P<type>(?:(?:\w++|[.<>\[\]?,()])\s*+)+?(?<=\s))?(?P<name>{W})\s*+(?:<[^()]*?>\s*+)?(?=\()"),
    "Kotlin": re.compile(rf"{_MODS}fun\s++(?:<[^()]*?>\s*+)?(?:{W}(?:<[^>]*>)?\.)?(?P<name>{W}|`[^`]*`)\s*+(?=\()"),
    "Scala": re.compile(rf"{_MODS}def\s++(?P<name>{W}|[^\s\w(]+)(?:\s*+\[[^\]]*\])?(?=\s*+(?:[(:={{]|$)|[^\S\n]*\n)"),
    "Swift": re.compile(rf"{_MODS}(?:func\s++(?P<name>{W})|(?P<init>init)[?!]?)\s*+(?:<[^()]*?>\s*+)?(?=\()"),
    "Cpp": re.compile(rf"(?:template\s*+<[^;{{}}]*?>\s*+)?{_MODS}(?P<type>(?:(?:\w++|[:<>,*&])\s*+)+?(?<=[\s*&>]))?(?P<name>{W})\s*+(?=\()"),
    "PHP": re.compile(rf"{_MODS}function\s++&?(?P<name>{W})\s*+(?=\()"),
}
_FIELD = {
    "Java": re.compile(rf"{_MODS}(?P<type>(?:(?:\w++|[.<>\[\]?,&])\s*+)+?)(?<=\s)(?P<names>{W}(?:\s*+\[\])?\s*+(?:=[^,]*)?(?:,\s*+{W}[^,]*)*)$"),
    "CSharp": re.compile(rf"{_MODS}(?P<type>(?:(?:\w++|[.<>\[\]?,()])\s*+)+?)(?<=\s)(?P<names>{W})\s*+(?P<get>\{{|=>|=|$)"),
    "Kotlin": re.compile(rf"{_MODS}(?P<kw>va[lr])\s++(?P<names>{W})\s*+(?::\s*+(?P<type>(?:[^=\s]++[^\S\n]*+)+?))?(?=\s*+(?:=|\bby\b|$)|\bby\b|[^\S\n]*\n)"),
    "Swift": re.compile(rf"{_MODS}(?P<kw>let|var)\s++(?P<names>{W})\s*+(?::\s*+(?P<type>(?:[^={{\s]++\s*+)+?))?(?P<get>[={{]|$)"),
    "Cpp": re.compile(rf"{_MODS}(?P<type>(?:(?:\w++|[:<>,*&])\s*+)+?)(?<=[\s*&>])(?P<names>{W})\s*+(?:\[[^\]]*\]\s*+)?(?:[={{]|$)"),
    "PHP": re.compile(rf"{_MODS}(?P<type>\??[\w\\|]++\s++)?\$(?P<names>{W})\s*+(?:=|$)"),
}
_NO_METHOD = set("if for while switch return throw new catch else do try foreach using lock super this sizeof alignas static_assert defined".split())


def _returns(src: Source, close: int, end: int, m: re.Match) -> str | None:
    language = src.language
    if language in ("Java", "CSharp", "Cpp"):
        kind = (m["type"] or "").strip()
        return re.sub(r"^(?:virtual|static|inline|constexpr|explicit|friend|extern)\s+", "", kind) or None
    tail = src.code[close + 1 : end]
    form = {"Swift": r"\s*(?:async\s+)?(?:throws\s*(?:\([^)]*\))?\s*|rethrows\s+)?->\s*([^{\n]+)", "Scala": r"\s*:\s*([^={\n]+)"}.get(language, r"\s*:\s*([^={;\n]+)")
    found = re.match(form, tail)
    return src.text(close + 1 + found.start(1), close + 1 + found.end(1)) if found else None


def _members(src: Source, body: tuple[int, int], owner: str, kind: str) -> tuple[list[dict], list[dict], list[dict], bool]:
    """(methods, signatures, properties, has pure virtual methods) of a type's body."""
    language = src.language
    lines = language in ("Kotlin", "Scala", "Swift")
    methods, signatures, properties, pure = [], [], [], False
    access = "public" if kind == "struct" else "private"  # the running access specifier of C++
    for start, end, block in src.members(body[0] + 1, body[1], lines):
        at = start
        while language == "Cpp" and (m := re.match(r"(public|private|protected)\s*:(?!:)\s*", src.code[at:end])):
            access, at = m[1], at + m.end()
        marks: list[str] = []
        while m := re.match(rf"@(?!interface\b)(?:{W}:)?{W}(?:\.{W})*\s*" if language not in ("CSharp", "PHP", "Cpp") else r"\#?(?=\[)", src.code[at:end]):
            stop = at + m.end()
            if src.code[stop : stop + 1] in ("(", "["):
                stop = src.close[stop] + 1
            marks.append(src.text(at, stop).lstrip("#"))
            at = stop + len(src.code[stop:end]) - len(src.code[stop:end].lstrip())
        decorators = _names(src, marks)
        m = _METHOD[language].match(src.code, at, end)
        name = m and (m.groupdict().get("init") or m["name"])
        if m and name and name not in _NO_METHOD and not (language == "Cpp" and (src.code[m.start("name") - 1 : m.start("name")] == "~" or name != owner and not m["type"])) and not (language in ("Java", "CSharp") and not (m["type"] or "").strip() and name != owner.split(".")[-1]):
            opened = src.code.find("(", m.end() - 1, end)
            chunks, close = [], m.end() - 1
            while opened >= 0 and not src.code[close + 1 : opened].strip():
                close = src.close[opened]
                chunks.append(src.raw[opened + 1 : close])
                nxt = re.match(r"\s*\(", src.code[close + 1 : end]) if language == "Scala" else None
                opened = close + nxt.end() if nxt else -1
            mods = m["mods"] or ""
            tail = src.code[close + 1 : end]
            is_pure = language == "Cpp" and bool(re.search(r"=\s*0\s*$", tail))
            pure |= is_pure
            has_body = block is not None or (language in ("Kotlin", "Scala") and bool(re.search(r"(?<![=<>!])=(?!=)", tail))) or (language == "CSharp" and "=>" in tail)
            given = [p for c in chunks for p in params(language, c)]
            returns = _returns(src, close, block[0] if block else end, m)
            if language == "Cpp" and returns:
                returns = returns.replace("virtual ", "").strip() or None
            common = {"name": name, "span": src.span(at, end), "parameters": given, "return_type": returns}
            is_async = (language == "CSharp" and "async" in mods.split()) or (language == "Kotlin" and "suspend" in mods.split())
            signatures.append(common | {"is_async": is_async, "has_default": not is_pure if language == "Cpp" else has_body})
            static = "static" in mods.split() or (language == "Swift" and "class" in mods.split()) or (language == "Cpp" and "static" in src.code[at : m.start("name")])
            methods.append(common | {"file": src.path, "visibility": access if language == "Cpp" else _visibility(language, mods, True), "is_async": is_async, "is_static": static, "is_generator": False, "decorators": [] if name == "init" else decorators, "owner": None, "implements": None})
            continue
        if language == "Scala":
            continue
        m = _FIELD[language].match(src.code, at, end)
        if not m or re.match(r"(?:return|using|friend|typedef|class|struct|enum|interface|case|use|const|fun|typealias|template)\b", src.code[at:end]):
            continue
        names = [re.match(rf"\s*({W})", x)[1] for x in split_top(m["names"])] if language == "Java" else [m["names"]]
        mods, kinds = (m["mods"] or "").split(), m.groupdict()
        kind_text = src.text(*m.span("type")) if kinds.get("type") else None
        readonly = {
            "Java": "final" in mods, "Kotlin": kinds.get("kw") == "val", "PHP": "readonly" in mods, "Cpp": bool(kind_text and re.search(r"\bconst\b", kind_text)),
            "Swift": kinds.get("kw") == "let" or (kind == "protocol" and "set" not in src.code[at:end]),
            "CSharp": "readonly" in mods if not (block and re.search(r"\bget\b", src.code[block[0] : block[1]])) else not re.search(r"\b(?:set|init)\b", src.code[block[0] : block[1]]),
        }[language]
        visibility = access if language == "Cpp" else _visibility(language, m["mods"] or "", True)
        for n in names:
            properties.append(prop(n, kind_text, bool(kind_text) and language in ("Kotlin", "Swift", "CSharp") and kind_text.endswith("?"), readonly, visibility) | {"_marks": decorators})
    return methods, signatures, properties, pure


def _supers(src: Source, start: int, end: int, kw: str) -> tuple[list[str], list[str]]:
    """(extends, implements) of a head."""
    language, head = src.language, src.raw[start:end]
    if language in ("Java", "PHP"):
        a = re.search(r"\bextends\s+([\s\S]*?)(?=\bimplements\b|\bpermits\b|$)", head)
        b = re.search(r"\bimplements\s+([\s\S]*?)(?=\bpermits\b|$)", head)
        return split_top(a[1]) if a else [], split_top(b[1]) if b else []
    if language == "Scala":
        m = re.search(r"\bextends\s+([\s\S]*)", head)
        return [re.sub(r"\([\s\S]*\)$", "", x).strip() for x in re.split(r"\bwith\b", m[1]) if x.strip()] if m else [], []
    depth, at = 0, -1
    for i, c in enumerate(head):
        depth += (c in "([<") - (c in ")]>")
        if c == ":" and depth == 0 and head[i + 1 : i + 2] != ":" and head[i - 1 : i] != ":":
            at = i
            break
    if at < 0:
        return [], []
    rest = re.split(r"\bwhere\b", head[at + 1 :])[0]
    found = [re.sub(r"\([\s\S]*\)$", "", re.sub(r"^(?:(?:public|private|protected|virtual)\s+)*", "", x)).strip() for x in split_top(rest)]
    return [x for x in found if x], []


def _class_kind(language: str, kw: str) -> str | None:
    table = {"interface": "interface", "trait": "trait", "protocol": "protocol"}
    return None if language == "Cpp" else table.get(kw)


def scan(src: Source) -> dict[str, list]:
    language, code = src.language, src.code
    out: dict[str, list] = {k: [] for k in ("interfaces", "classes", "functions", "imports", "services", "schemas", "implementations")}
    heads = list(_TYPES[language].finditer(code))
    traits: list[dict] = []
    for m in heads:
        kw, name = m["kw"].split()[0], m["name"]
        if language == "Swift" and kw == "class" and re.match(r"(?:func|var|let|subscript)$", name) or language == "Scala" and name == "extends":
            continue
        line = code.find("\n", m.end())
        body = src.body(m.end(), ";" if language not in ("Kotlin", "Scala") else ";")
        if language in ("Kotlin", "Scala") and body and re.search(r"\n\s*(?:[\w@]+\s+)*(?:class|interface|object|trait|fun|def|va[lr]|import)\b", code[m.end() : body[0]]):
            body = None
        if not body and language in ("Cpp", "PHP", "Swift") or kw in ("enum", "@interface"):
            continue
        paren = _PRIMARY.match(code, m.end())
        head_end = body[0] if body else (src.close[paren.end() - 1] + 1 if paren else (line if line >= 0 else len(code)))
        end = min(body[1] + 1, len(code)) if body else head_end
        start, mods = m.start(), m["mods"] or ""
        raw = _before(src, start)
        decorators = _names(src, raw)
        extends, implements = _supers(src, m.end(), head_end, kw)
        generics = split_top((m["generics"] or "")[1:-1])
        if language == "Cpp":
            generics = _template(src, start) or generics
        inside = body or (end, end)
        methods, signatures, properties, pure = _members(src, inside, name, kw)
        plain = [{k: v for k, v in p.items() if k != "_marks"} for p in properties]
        visibility = _visibility(language, mods)
        base = {"name": name, "file": src.path, "span": src.span(start, end), "visibility": visibility, "generics": generics}
        interface_kind = _class_kind(language, kw)
        if language == "Swift" and kw == "extension":
            out["implementations"].append({"target": name, "trait_name": extends[0] if extends else None, "file": src.path, "span": src.span(start, end), "methods": methods})
            continue
        if interface_kind or (language == "Cpp" and pure):
            made = base | {"extends": extends, "methods": signatures, "properties": plain, "language_kind": interface_kind or "pure_virtual", "decorators": decorators}
            (traits if language == "PHP" and kw == "trait" else out["interfaces"]).append(made)
            if interface_kind:
                continue
        record = kw == "record"
        if language in ("Java", "Swift", "Cpp", "PHP", "Kotlin", "Scala", "CSharp"):
            split = language in ("Java", "PHP")
            first = extends[0] if extends else None
            rest = implements if split else extends[1:]
            out["classes"].append(base | {"extends": first, "implements": rest, "methods": methods, "properties": plain, "is_abstract": "abstract" in mods.split() or (language == "Scala" and kw == "object") or (language == "Cpp" and pure), "decorators": decorators})
        names = [re.match(r"[\w.]+", d)[0] for d in decorators if re.match(r"[\w.]+", d)]
        services = {"Java": JAVA_SERVICES, "Kotlin": JAVA_SERVICES, "CSharp": CSHARP_SERVICES}.get(language, {})
        kind = next((services[n] for n in names if n in services), None)
        if language == "Swift":
            kind = next((v for k, v in SWIFT_SERVICES.items() if name.endswith(k)), None)
        if kind:
            verbs = {"Java": JAVA_VERBS, "CSharp": CSHARP_VERBS}.get(language, {})
            routes = [{"method": verbs[n], "path": decorator_arg(d), "handler": x["name"]} for x in methods for d in x["decorators"] if (n := re.match(r"[\w.]*", d)[0]) in verbs]
            out["services"].append({"name": name, "file": src.path, "span": src.span(start, end), "kind": kind, "methods": methods, "dependencies": [], "decorators": decorators, "routes": routes})
        _schema(src, out, m, paren, extends, properties, methods, names, mods, record, start, end, visibility)
    out["interfaces"] += traits
    _functions(src, out)
    _imports(src, out)
    seen: set[tuple] = set()
    out["schemas"] = [s for s in out["schemas"] if not ((key := (s["name"], s["span"]["start_line"])) in seen or seen.add(key))]
    return out


def _schema(src, out, m, paren, extends, properties, methods, names, mods, record, start, end, visibility) -> None:
    language, name = src.language, m["name"]
    inner = src.raw[paren.end() : src.close[paren.end() - 1]] if paren else ""
    made = None
    if language == "Java":
        if record:
            made = ("data_transfer", "java-record", [field(n, t) for n, t, *_ in _before_name(inner)])
        elif "Entity" in names:
            made = ("orm_model", "jpa", [field(p["name"], p["type_annotation"], False, "Id" in p["_marks"]) for p in properties])
    elif language == "CSharp":
        if record:
            made = ("data_transfer", "csharp-record", [field(n, t, t.endswith("?")) for n, t, *_ in _before_name(inner)])
        elif "Table" in names or "Entity" in names:
            made = ("orm_model", "ef-core", [field(p["name"], p["type_annotation"], p["is_optional"], any(re.match(r"Key\b", d) for d in p["_marks"])) for p in properties])
    elif language == "Kotlin" and "data" in mods.split():
        made = ("data_transfer", "kotlin-data-class", [field(n, t, t.endswith("?")) for n, t, _ in _after_name(inner)])
    elif language == "Swift" and any(x in ("Codable", "Decodable", "Encodable") for x in extends):
        made = ("data_transfer" if m["kw"] == "struct" else "orm_model", "codable", [field(p["name"], p["type_annotation"], (p["type_annotation"] or "").endswith("?")) for p in properties])
    elif language == "Cpp" and m["kw"] == "struct" and not methods and properties:
        made = ("data_transfer", "cpp-struct", [field(p["name"], p["type_annotation"]) for p in properties])
    if made:
        table = next((decorator_arg(x) or None for x in _before(src, start) if "Table" in x and "(" in x), None)
        out["schemas"].append({"name": name, "file": src.path, "span": src.span(start, end), "kind": made[0], "fields": made[2], "source_framework": made[1], "table_name": table, "derives": [], "visibility": visibility})


def _functions(src: Source, out: dict[str, list]) -> None:
    language = src.language
    if language not in ("Kotlin", "Swift", "Cpp", "PHP"):
        return
    top = (0, len(src.code))
    todo = [top]
    while todo:
        lo, hi = todo.pop()
        for start, end, block in src.members(lo, hi, language in ("Kotlin", "Swift")):
            text = src.code[start:end]
            if block and re.match(r"(?:namespace\b|extern\s*\"|inline\s+namespace)", text):
                todo.append((block[0] + 1, block[1]))
                continue
            at = start + len(re.match(r"(?:\s*(?:\#[^\n]*\n|<\?php|@\w+(?:\([^)]*\))?))*\s*", text)[0])
            m = _METHOD[language].match(src.code, at, end)
            if not m or not m["name"] or (language == "Cpp" and (not block or not (m["type"] or "").strip() or m["name"] in _NO_METHOD)) or (language == "PHP" and not block):
                continue
            opened = src.code.find("(", m.end() - 1)
            close = src.close[opened]
            mods = m["mods"] or ""
            out["functions"].append({"name": m["name"], "file": src.path, "span": src.span(at, end), "visibility": _visibility(language, mods), "is_async": "suspend" in mods.split() or "async" in src.code[close : block[0] if block else end], "is_generator": False, "parameters": params(language, src.raw[opened + 1 : close]), "return_type": _returns(src, close, block[0] if block else end, m), "decorators": _names(src, _before(src, at))})
    out["functions"].sort(key=lambda f: f["span"]["byte_range"]["start"])


_IMPORTS = {
    "Java": r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", "Kotlin": r"^[ \t]*import\s+([\w.]+?)(\.\*)?(?:\s+as\s+(\w+))?[ \t]*;?[ \t]*$", "Scala": r"^[ \t]*import\s+([\w.]+?)(?:\.(\{[^}]*\}|_|\*))?[ \t]*;?[ \t]*$",
    "CSharp": r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;", "Swift": r"^[ \t]*(?:@\w+\s+)?import\s+(?:class\s+|struct\s+|func\s+|enum\s+|protocol\s+)?([\w.]+)",
    "Cpp": r"^[ \t]*#[ \t]*include[ \t]*(?:<([^>\n]+)>|\"([^\"\n]+)\")|^[ \t]*(?:export\s+)?import\s+([\w.:]+)\s*;", "PHP": r"^[ \t]*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*;",
}
_IMPORT = {k: re.compile(v, re.M) for k, v in _IMPORTS.items()}


def _imports(src: Source, out: dict[str, list]) -> None:
    language = src.language
    for m in _IMPORT[language].finditer(src.lined):
        if not src.code[m.start() : m.end()].strip():
            continue
        if language == "PHP" and src.depth(m.start()):
            continue
        symbols, wild = [], False
        if language in ("Java", "Kotlin"):
            wild = bool(m[2])
            dotted = not wild and "." in m[1]
            source, _, last = m[1].rpartition(".") if dotted else (m[1], "", "")
            if dotted:
                symbols = [symbol(last, m[3] if language == "Kotlin" else None)]
        elif language == "Scala":
            wild = m[2] in ("_", "*")
            dotted = not m[2] and "." in m[1]
            source, _, last = m[1].rpartition(".") if dotted else (m[1], "", "")
            if m[2] and m[2].startswith("{"):
                for one in split_top(m[2][1:-1]):
                    name, _, alias = re.sub(r"\s*=>\s*|\s+as\s+", "\0", one).partition("\0")
                    wild |= name in ("_", "*")
                    if name not in ("_", "*"):
                        symbols.append(symbol(name, alias or None))
            elif dotted:
                symbols = [symbol(last)]
        elif language == "CSharp":
            source, wild = m[2], "." not in m[2]
            symbols = [] if wild else [symbol(source.rpartition(".")[2], m[1])]
        elif language == "Swift":
            source, wild = m[1], True
        elif language == "Cpp":
            source, wild = m[1] or m[2] or m[3], True
        else:
            source = m[1]
            symbols = [symbol(source.rpartition("\\")[2], m[2])]
        out["imports"].append({"source": source, "symbols": symbols, "is_wildcard": wild, "span": src.span(m.start(), m.end())})
