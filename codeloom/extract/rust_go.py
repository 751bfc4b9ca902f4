"""Rust and Go."""

from __future__ import annotations

import re

from codeloom.extract.text import Source, field, parameter, prop, split_top, symbol

W = r"[^\W\d]\w*"
# ------------------------------------------------------------------ Rust
_RS_VIS = r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?"
_RS_ITEM = re.compile(rf"(?<![\w.]){_RS_VIS}(?:unsafe\s+|auto\s+)*(?P<kw>trait|struct|enum|union)\s+(?P<name>{W})\s*(?P<generics><[^{{}};()]*>)?")
_RS_FN = re.compile(rf"(?<![\w.]){_RS_VIS}(?P<mods>(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*)fn\s+(?P<name>{W})(?=\s*[<(])")
_RS_IMPL = re.compile(r"(?<![\w.>&])(?:default\s+)?(?:unsafe\s+)?impl\b")
_RS_HEAD_END = re.compile(r"[{};]")
_RS_USE = re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", re.M)
_RS_TYPE = re.compile(rf"^[ \t]*{_RS_VIS}type\s+(?P<name>{W})\s*(?P<generics><[^=;]*>)?\s*=\s*(?P<target>[^;]+);", re.M)


def _rs_visibility(vis: str | None) -> str:
    return "private" if not vis else "crate" if "(" in vis else "public"


def _rs_attributes(src: Source, at: int) -> list[str]:
    """Texts of the attributes right before a place."""
    out: list[str] = []
    while True:
        end = src.solid(at)
        opened = src.opener.get(end - 1) if end and src.code[end - 1] == "]" else None
        if opened is None or src.code[opened - 1 : opened] != "#":
            return out
        out.insert(0, src.text(opened - 1, end))
        at = opened - 1


def _rs_open(src: Source, m: re.Match) -> int:
    """The parenthesis of a function's parameters, behind its type parameters; -1 if there is none."""
    at = src.skip(src.angles(src.skip(m.end())))
    return at if src.code[at : at + 1] == "(" else -1


def _rs_returns(src: Source, close: int, stop: int) -> str | None:
    """What stands between the -> behind a function's parameters and its where clause, block or end."""
    at = src.skip(close + 1)
    if not src.code.startswith("->", at):
        return None
    where = re.search(r"\bwhere\b", src.code[at:stop])
    return src.text(at + 2, at + where.start() if where else stop)


def _rs_params(text: str) -> list[dict]:
    out = []
    for p in split_top(text):
        p = re.sub(r"^(?:#\[[^\]]*\]\s*)*(?:mut\s+)?", "", p)
        if re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self(?:\s*:[\s\S]+)?", p):
            out.append(parameter("self", p))
        else:
            name, _, kind = p.partition(":")
            out.append(parameter(name.strip(), kind.strip(), kind.strip().startswith("Option<")))
    return out


def _rs_methods(src: Source, body: tuple[int, int]) -> list[tuple[dict, bool]]:
    out = []
    for m in _RS_FN.finditer(src.code, body[0] + 1, body[1]):
        if src.depth(m.start()) != src.depth(body[0] + 1):
            continue
        opened = _rs_open(src, m)
        if opened < 0:
            continue
        close = src.close[opened]
        block = src.body(close + 1, ";")
        end = min(block[1] + 1, len(src.code)) if block else src.code.find(";", close) + 1 or len(src.code)
        returns = _rs_returns(src, close, block[0] if block else end - 1)
        given = _rs_params(src.raw[opened + 1 : close])
        out.append(({"name": m["name"], "file": src.path, "span": src.span(m.start(), end), "visibility": _rs_visibility(m["vis"]), "is_async": "async" in m["mods"], "is_static": False, "is_generator": False, "parameters": given, "return_type": returns, "decorators": _rs_attributes(src, m.start()), "owner": None, "implements": None}, block is not None))
    return out


def _rs_fields(src: Source, body: tuple[int, int]) -> list[tuple[str, str, str]]:
    out = []
    for part in split_top(re.sub(r"#\[[^\]]*\]", lambda m: " " * len(m[0]), src.code[body[0] + 1 : body[1]])):
        m = re.match(rf"{_RS_VIS}({W})\s*:\s*([\s\S]+)", part)
        if m:
            out.append((m[2], m[3].strip(), _rs_visibility(m["vis"])))
    return out


def scan_rust(src: Source) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("interfaces", "classes", "functions", "implementations", "type_aliases", "imports", "services", "schemas")}
    code = src.code
    for m in _RS_ITEM.finditer(code):
        body = src.body(m.end(), ";")
        tuple_end = code.find(";", m.end())
        if not body and m["kw"] in ("trait", "enum"):
            continue
        end = min(body[1] + 1, len(code)) if body else tuple_end + 1 or len(code)
        attributes = _rs_attributes(src, m.start())
        generics = split_top((m["generics"] or "")[1:-1])
        base = {"name": m["name"], "file": src.path, "span": src.span(m.start(), end), "visibility": _rs_visibility(m["vis"]), "generics": generics}
        if m["kw"] == "trait":
            bounds = re.match(r"\s*:\s*([^{]*?)(?:\bwhere\b[^{]*)?$", code[m.end() : body[0]])
            methods = [{k: x[k] for k in ("name", "span", "is_async", "parameters", "return_type")} | {"has_default": has} for x, has in _rs_methods(src, body)]
            out["interfaces"].append(base | {"extends": split_top(bounds[1], "+") if bounds else [], "methods": methods, "properties": [], "language_kind": "trait", "decorators": attributes})
            continue
        fields = _rs_fields(src, body) if body and m["kw"] != "enum" else []
        props = [prop(n, t, t.startswith("Option<"), False, v) for n, t, v in fields]
        out["classes"].append(base | {"extends": None, "implements": [], "methods": [], "properties": props, "is_abstract": False, "decorators": attributes})
        if m["kw"] == "struct" and any("Serialize" in a or "Deserialize" in a for a in attributes):
            derives = [x for a in attributes if (d := re.search(r"derive\s*\(([^)]*)\)", a)) for x in split_top(d[1])]
            out["schemas"].append({"name": m["name"], "file": src.path, "span": base["span"], "kind": "data_transfer", "fields": [field(n, t, t.startswith("Option<")) for n, t, _ in fields], "source_framework": "serde", "table_name": None, "derives": derives, "visibility": base["visibility"]})
    impl_bodies = []
    for m in _RS_IMPL.finditer(code):
        before = src.solid(m.start())
        if before and code[before - 1] in ">(,:=&<+|":
            continue  # a type, not a block
        start = src.angles(src.skip(m.end()))
        stop = _RS_HEAD_END.search(code, start)
        if not stop or stop[0] != "{":
            continue
        body = (stop.start(), src.close[stop.start()])
        impl_bodies.append(body)
        head = re.split(r"\bwhere\b", src.raw[start : stop.start()])[0].strip()
        trait, _, target = re.sub(r"\s+for\s+(?!<)", "\0", head, count=1).partition("\0")
        trait, target = (trait.strip(), target.strip()) if target else (None, trait.strip())
        methods = [x for x, _ in _rs_methods(src, body)]
        span = src.span(m.start(), min(body[1] + 1, len(code)))
        out["implementations"].append({"target": target, "trait_name": trait, "file": src.path, "span": span, "methods": methods})
        attributes = _rs_attributes(src, m.start())
        if trait and any("tonic" in a or "async_trait" in a for a in attributes):
            out["services"].append({"name": target, "file": src.path, "span": span, "kind": "grpc_service", "methods": methods, "dependencies": [], "decorators": attributes, "routes": []})
    held = {*impl_bodies, *(b for m in _RS_ITEM.finditer(code) if m["kw"] == "trait" and (b := src.body(m.end(), ";")))}
    for m in _RS_FN.finditer(code):
        opened = _rs_open(src, m)
        if opened < 0 or next(src.around(m.start()), None) in held:
            continue
        close = src.close[opened]
        block = src.body(close + 1, ";")
        end = min(block[1] + 1, len(code)) if block else code.find(";", close) + 1 or len(code)
        returns = _rs_returns(src, close, block[0] if block else end - 1)
        out["functions"].append({"name": m["name"], "file": src.path, "span": src.span(m.start(), end), "visibility": _rs_visibility(m["vis"]), "is_async": "async" in m["mods"], "is_generator": False, "parameters": _rs_params(src.raw[opened + 1 : close]), "return_type": returns, "decorators": _rs_attributes(src, m.start())})
    for m in _RS_TYPE.finditer(code):
        if any(b in held for b in src.around(m.start())):
            continue
        out["type_aliases"].append({"name": m["name"], "file": src.path, "span": src.span(m.start(), m.end()), "target": src.text(*m.span("target")), "generics": split_top((m["generics"] or "")[1:-1]), "visibility": _rs_visibility(m["vis"])})
    for m in _RS_USE.finditer(code):
        out["imports"].append(use_path(src.raw[m.start(1) : m.end(1)]) | {"span": src.span(m.start(), m.end())})
    return out


def use_path(text: str) -> dict:
    """Source and symbols of a use: what stands before and after the last ::, braces listing several symbols."""
    text = " ".join(text.split())
    brace = text.find("{")
    head, _, tail = (text[:brace].rstrip(":").strip(), "", text[brace + 1 : text.rfind("}")]) if brace >= 0 else text.rpartition("::")
    symbols = []
    for one in split_top(tail):
        name, _, alias = one.partition(" as ")
        if name.strip() not in ("*", ""):
            symbols.append(symbol(name.strip(), alias.strip() or None))
    return {"source": head or tail, "symbols": symbols, "is_wildcard": "*" in text}


# ------------------------------------------------------------------ Go
_GO_TYPE = re.compile(rf"(?:^[ \t]*type\s+|(?<=[\n(;])[ \t]*)(?P<name>{W})\s*(?P<generics>\[[^\]]*\])?\s+(?P<kw>struct|interface)\s*(?=\{{)", re.M)
_GO_FUNC = re.compile(rf"^func\s*(?P<recv>\([^)]*\))?\s*(?P<name>{W})\s*(?:\[[^\]]*\])?\s*(?=\()", re.M)
_GO_IMPORT = re.compile(r"^import\s*(?:\((?P<many>[^)]*)\)|(?P<one>[^\n(]+))", re.M)
_GO_FIELD = re.compile(rf"({W}(?:\s*+,\s*+{W})*+)\s++(?=\S)")
_GO_TAG = re.compile(r"`[^`]*`|\"[^\"\n]*\"")
_GO_SPEC = re.compile(r"(?:([\w.]+)\s+)?\"([^\"\n]+)\"")


def _go_visibility(name: str) -> str:
    return "public" if name[:1].isupper() else "private"


def _go_params(text: str) -> list[dict]:
    parts, out, waiting = split_top(text), [], []
    named = any(re.match(rf"{W}\s+\S", p) for p in parts)
    for p in parts:
        m = re.match(rf"({W})\s+([\s\S]+)", p) if named else None
        if m:
            rest = m[2].startswith("...")
            out += [parameter(n, m[2], rest, False, rest) for n in [*waiting, m[1]]]
            waiting = []
        elif named:
            waiting.append(p)
        else:
            out.append(parameter("", p, p.startswith("..."), False, p.startswith("...")))
    return out


def _go_returns(src: Source, close: int, end: int) -> str | None:
    return src.text(close + 1, end).rstrip("{").strip() or None


def _go_fields(src: Source, body: tuple[int, int]) -> list[tuple[str, str, str]]:
    out = []
    for start, end, _ in src.members(body[0] + 1, body[1], True):
        m = _GO_FIELD.match(src.code, start, end)
        if not m:
            continue
        tag = _GO_TAG.search(src.code, m.end(), end)
        kind = src.text(m.end(), tag.start() if tag else src.solid(end))
        if kind and "\n" not in kind:
            out += [(n.strip(), kind, src.raw[tag.start() + 1 : tag.end() - 1] if tag else "") for n in m[1].split(",")]
    return out


def scan_go(src: Source) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("interfaces", "classes", "functions", "implementations", "imports", "schemas")}
    code = src.code
    for m in _GO_TYPE.finditer(code):
        body = (m.end(), src.close[m.end()])
        end = min(body[1] + 1, len(code))
        at = src.span(m.start("name"), end)
        generics = split_top((m["generics"] or "")[1:-1])
        base = {"name": m["name"], "file": src.path, "span": at, "visibility": _go_visibility(m["name"]), "generics": generics}
        if m["kw"] == "interface":
            methods, embedded = [], []
            for start, stop, _ in src.members(body[0] + 1, body[1], True):
                x = re.match(rf"({W})\s*\(", code[start:stop])
                if x:
                    close = src.close[start + x.end() - 1]
                    methods.append({"name": x[1], "span": src.span(start, stop), "is_async": False, "parameters": _go_params(src.raw[start + x.end() : close]), "return_type": _go_returns(src, close, stop), "has_default": False})
                else:
                    embedded.append(src.text(start, stop))
            out["interfaces"].append(base | {"extends": embedded, "methods": methods, "properties": [], "language_kind": "interface", "decorators": []})
            continue
        fields = _go_fields(src, body)
        out["classes"].append(base | {"extends": None, "implements": [], "methods": [], "properties": [prop(n, t, False, False, _go_visibility(n)) for n, t, _ in fields], "is_abstract": False, "decorators": []})
        if any(re.search(r"\b(?:json|db|xml|yaml):", tag) for _, _, tag in fields):
            out["schemas"].append({"name": m["name"], "file": src.path, "span": at, "kind": "data_transfer", "fields": [field(n, t, t.startswith("*"), False, ["omitempty"] if "omitempty" in tag else []) for n, t, tag in fields], "source_framework": "go-tags", "table_name": None, "derives": [], "visibility": base["visibility"]})
    by_receiver: dict[str, list[dict]] = {}
    for m in _GO_FUNC.finditer(code):
        opened = code.find("(", m.end() - 1)
        close = src.close[opened]
        line = code.find("\n", close)
        line = line if line >= 0 else len(code)
        at = close + 1
        results = re.match(r"\s*\(", code[at:line])
        if results:
            at = src.close[at + results.end() - 1] + 1
        brace = code.find("{", at)
        while 0 <= brace and re.search(r"\b(?:interface|struct)\s*$", code[at:brace]):
            brace = code.find("{", src.close[brace])
        block = (brace, src.close[brace]) if 0 <= brace and (brace <= line) else None
        end = min(block[1] + 1, len(code)) if block else line
        common = {"name": m["name"], "file": src.path, "span": src.span(m.start(), end), "visibility": _go_visibility(m["name"]), "is_async": False, "is_generator": False, "parameters": _go_params(src.raw[opened + 1 : close]), "return_type": _go_returns(src, close, block[0] if block else line), "decorators": []}
        if m["recv"]:
            owner = re.sub(r"\[[^\]]*\]", "", m["recv"][1:-1].split()[-1]).lstrip("*") if m["recv"][1:-1].split() else ""
            by_receiver.setdefault(owner, []).append(common | {"is_static": False, "owner": owner, "implements": None})
        else:
            out["functions"].append(common)
    for owner in sorted(by_receiver):
        methods = by_receiver[owner]
        out["implementations"].append({"target": owner, "trait_name": None, "file": src.path, "span": methods[0]["span"], "methods": methods})
    for m in _GO_IMPORT.finditer(src.lined):
        if not code[m.start() : m.start() + 6] == "import":
            continue
        inner, base = (m["many"], m.start("many")) if m["many"] is not None else (m["one"], m.start("one"))
        for x in _GO_SPEC.finditer(inner):
            alias, source = x[1], x[2]
            wild = alias == "."
            out["imports"].append({"source": source, "symbols": [] if wild else [symbol(source.rpartition("/")[2], alias)], "is_wildcard": wild, "span": src.span(base + x.start(), base + x.end())})
    return out
