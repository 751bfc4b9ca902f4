"""Python and Ruby."""

from __future__ import annotations

import ast
import re
import warnings

from codeloom.extract.text import Source, decorator_arg, field, parameter, prop, split_top, strip_quotes, symbol

W = r"[^\W\d]\w*"
# What bases and decorators stand for.
SCHEMA_BASES = {"BaseModel": ("validation_schema", "pydantic"), "TypedDict": ("data_transfer", "typeddict"), "Base": ("orm_model", "sqlalchemy"), "DeclarativeBase": ("orm_model", "sqlalchemy"), "db.Model": ("orm_model", "sqlalchemy")}
PY_SERVICES = {"get": "http_controller", "post": "http_controller", "put": "http_controller", "patch": "http_controller", "delete": "http_controller", "route": "http_controller", "api_view": "http_controller", "websocket": "event_handler", "middleware": "middleware"}
PY_VERBS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE"}


def _py_visibility(name: str) -> str:
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "unknown"


class _Python:
    def __init__(self, src: Source, tree: ast.AST) -> None:
        self.src, self.tree = src, tree
        self.data = src.raw.encode()
        self.starts = [0]
        for line in self.data.split(b"\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)

    def text(self, node: ast.AST | None) -> str | None:
        if node is None:
            return None
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.data[a:b].decode("utf-8", "replace").strip()

    def span(self, node: ast.AST) -> dict:
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset
        return {"start_line": node.lineno - 1, "start_col": node.col_offset, "end_line": node.end_lineno - 1, "end_col": node.end_col_offset, "byte_range": {"start": a, "end": b}}

    def params(self, args: ast.arguments) -> list[dict]:
        plain = [*args.posonlyargs, *args.args]
        first = len(plain) - len(args.defaults)
        out = [parameter(a.arg, self.text(a.annotation), i >= first, i >= first) for i, a in enumerate(plain)]
        if args.vararg:
            out.append(parameter(args.vararg.arg, self.text(args.vararg.annotation), True, False, True))
        out += [parameter(a.arg, self.text(a.annotation), d is not None, d is not None) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
        if args.kwarg:
            out.append(parameter(args.kwarg.arg, self.text(args.kwarg.annotation), True, False, True))
        return [p for p in out if p["name"] not in ("self", "cls")]

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
        own = "yield" in self.src.raw and any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node))
        return {
            "name": node.name, "file": self.src.path, "span": self.span(node), "visibility": _py_visibility(node.name), "is_async": isinstance(node, ast.AsyncFunctionDef), "is_generator": own,
            "parameters": self.params(node.args), "return_type": self.text(node.returns), "decorators": [self.text(d) for d in node.decorator_list],
        }

    def scan(self) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("interfaces", "classes", "functions", "imports", "services", "schemas")}
        members: set[ast.AST] = set()
        found, todo = [], [self.tree]
        while todo:  # statements only: expressions hold no declarations
            node = todo.pop()
            for name in ("body", "orelse", "finalbody", "handlers", "cases"):
                todo += [x for x in getattr(node, name, ()) if isinstance(x, (ast.stmt, ast.excepthandler, ast.match_case))] if isinstance(getattr(node, name, None), list) else []
            if isinstance(node, ast.ClassDef):
                members |= {x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))}
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Import, ast.ImportFrom)):
                found.append(node)
        for node in sorted(found, key=lambda n: (n.lineno, n.col_offset)):
            if isinstance(node, ast.ClassDef):
                self.type(node, out)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.service(node, out)
                if node not in members:
                    out["functions"].append(self.function(node))
            elif isinstance(node, ast.Import):
                out["imports"] += [{"source": a.name, "symbols": [symbol(a.name, a.asname)] if a.asname else [], "is_wildcard": False, "span": self.span(node)} for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                wild = any(a.name == "*" for a in node.names)
                names = [symbol(a.name, a.asname) for a in node.names if a.name != "*"]
                out["imports"].append({"source": "." * node.level + (node.module or ""), "symbols": names, "is_wildcard": wild, "span": self.span(node)})
        return out

    def type(self, node: ast.ClassDef, out: dict[str, list]) -> None:
        bases = [self.text(b) for b in node.bases]
        decorators = [self.text(d) for d in node.decorator_list]
        heads = [b.partition("[")[0].rpartition(".")[2] for b in bases]
        props = []
        for x in node.body:
            target = x.target if isinstance(x, ast.AnnAssign) else x.targets[0] if isinstance(x, ast.Assign) else None
            if isinstance(target, ast.Name):
                props.append(prop(target.id, None, False, False, _py_visibility(target.id)))
        base = {"name": node.name, "file": self.src.path, "span": self.span(node), "visibility": _py_visibility(node.name), "generics": []}
        if "Protocol" in heads or "ABC" in heads:
            kind = "protocol" if "Protocol" in heads else "abstract_class"
            out["interfaces"].append(base | {"extends": [b for b, h in zip(bases, heads) if h not in ("Protocol", "ABC")], "methods": [], "properties": props, "language_kind": kind, "decorators": decorators})
        else:
            methods = []
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and x.name != "__init__":
                    made = self.function(x)
                    methods.append(made | {"is_static": "staticmethod" in made["decorators"], "owner": node.name, "implements": None})
            out["classes"].append(base | {"extends": bases[0] if bases else None, "implements": bases, "methods": methods, "properties": props, "is_abstract": False, "decorators": decorators})
        kind = next((SCHEMA_BASES[b] for b in bases if b in SCHEMA_BASES), None) or next((("data_transfer", "dataclass") for d in decorators if d.partition("(")[0].rpartition(".")[2] == "dataclass"), None)
        if kind:
            table = next((strip_quotes(self.text(x.value)) for x in node.body if isinstance(x, ast.Assign) and isinstance(x.targets[0], ast.Name) and x.targets[0].id == "__tablename__"), None)
            out["schemas"].append({"name": node.name, "file": self.src.path, "span": self.span(node), "kind": kind[0], "fields": [field(p["name"], None) for p in props if not p["name"].startswith("__")], "source_framework": kind[1], "table_name": table, "derives": [], "visibility": base["visibility"]})

    def service(self, node: ast.FunctionDef | ast.AsyncFunctionDef, out: dict[str, list]) -> None:
        for d in node.decorator_list:
            text = self.text(d)
            last = text.partition("(")[0].rpartition(".")[2]
            if last in PY_SERVICES:
                made = self.function(node)
                verb = PY_VERBS.get(last)
                routes = [{"method": verb or "GET", "path": decorator_arg(text).split(",")[0].strip().strip("\"'"), "handler": node.name}] if verb or last in ("route", "api_view") else []
                method = made | {"is_static": False, "owner": None, "implements": None}
                out["services"].append({"name": node.name, "file": self.src.path, "span": made["span"], "kind": PY_SERVICES[last], "methods": [method], "dependencies": [], "decorators": made["decorators"], "routes": routes})
                return


_PY_HEAD = re.compile(rf"^(?P<indent>[ \t]*)(?:(?P<class>class)|(?:(?P<async>async)\s+)?def)\s+(?P<name>{W})\s*(?P<args>\([^)]*\))?", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*(?:from\s+(\S+)\s+import\s+([^\n#]+)|import\s+([^\n#]+))", re.M)


def scan_python(src: Source) -> dict[str, list]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return _Python(src, ast.parse(src.raw.lstrip("﻿"))).scan()
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    out: dict[str, list] = {k: [] for k in ("interfaces", "classes", "functions", "imports", "services", "schemas")}
    heads = list(_PY_HEAD.finditer(src.code))
    for m in heads:  # a file that does not parse still gives its heads
        end = next((x.start() for x in heads if x.start() > m.start() and len(x["indent"]) <= len(m["indent"])), len(src.code))
        while end > m.end() and src.code[end - 1].isspace():
            end -= 1
        span = src.span(m.start() + len(m["indent"]), end)
        if m["class"]:
            bases = split_top((m["args"] or "()")[1:-1])
            out["classes"].append({"name": m["name"], "file": src.path, "span": span, "visibility": _py_visibility(m["name"]), "generics": [], "extends": bases[0] if bases else None, "implements": bases, "methods": [], "properties": [], "is_abstract": False, "decorators": []})
        elif not m["indent"]:
            names = [re.split(r"[:=]", p)[0].strip().lstrip("*") for p in split_top((m["args"] or "()")[1:-1])]
            out["functions"].append({"name": m["name"], "file": src.path, "span": span, "visibility": _py_visibility(m["name"]), "is_async": bool(m["async"]), "is_generator": False, "parameters": [parameter(n) for n in names if n not in ("self", "cls", "", "/")], "return_type": None, "decorators": []})
    for m in _PY_IMPORT.finditer(src.code):
        span = src.span(m.start(), m.end())
        if m[1]:
            names = [x.partition(" as ") for x in split_top(m[2].strip("() \t"))]
            out["imports"].append({"source": m[1], "symbols": [symbol(a.strip(), c.strip() or None) for a, _, c in names if a.strip() != "*"], "is_wildcard": "*" in m[2], "span": span})
        else:
            out["imports"] += [{"source": x.partition(" as ")[0].strip(), "symbols": [], "is_wildcard": False, "span": span} for x in split_top(m[3])]
    return out


# ------------------------------------------------------------------ Ruby
_RB_WORD = re.compile(r"(?m)(?P<head>^[ \t]*(?P<kw>module|class|def)\b(?!\s*<<)[ \t]*(?P<name>[\w:.?!=\[\]+*/<>%-]+)?[^\n]*)|(?<![\w.:])(?P<open>begin|case|do|for)\b(?![:?])|(?P<cond>(?:^|=|\(|;)[ \t]*(?:if|unless|while|until)\b)|(?<![\w.:])(?P<end>end)\b(?![:?])")
_RB_IMPORT = re.compile(r"^[ \t]*(require|require_relative|include|extend|load)[ \t(]+([^\n#;)]+)", re.M)


def _rb_params(text: str) -> list[dict]:
    out = []
    for p in split_top(text):
        m = re.match(r"(\*\*|\*|&)?\s*(\w+)?\s*(:(?!:)|=)?\s*(\S[\s\S]*)?$", p)
        if not m or not (m[2] or m[1]):
            continue
        default = bool(m[4]) and m[3] is not None
        out.append(parameter(m[2] or m[1], None, default or m[1] == "&", default, m[1] in ("*", "**")))
    return out


def scan_ruby(src: Source) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("interfaces", "classes", "imports")}
    code = src.code
    stack: list[dict] = []
    for m in _RB_WORD.finditer(code):
        if m["kw"]:
            line = m["head"]
            one_line = bool(re.search(r"\bend\s*$", line)) or (m["kw"] == "def" and bool(re.match(r"[ \t]*def\s+[\w.?!]+\s*(?:\([^)]*\))?\s*=[^=~>]", line)))
            at = m.start() + len(line) - len(line.lstrip())
            node = {"kw": m["kw"], "name": m["name"] or "", "start": at, "line": line, "methods": [], "head_end": m.end()}
            owner = next((x for x in reversed(stack) if x["kw"] in ("class", "module")), None)
            node["owner"] = owner
            if one_line:
                _rb_close(src, node, m.end(), out)
            else:
                stack.append(node)
        elif m["end"]:
            if stack:
                _rb_close(src, stack.pop(), m.end(), out)
        elif not (m["open"] == "do" and stack and stack[-1]["kw"] == "loop" and stack[-1]["row"] == src.line(m.start())):
            stack.append({"kw": "loop" if m["cond"] and re.search(r"while|until", m["cond"]) or m["open"] == "for" else "block", "row": src.line(m.start())})
    while stack:
        _rb_close(src, stack.pop(), len(code), out)
    for key in ("interfaces", "classes"):
        out[key].sort(key=lambda x: x["span"]["byte_range"]["start"])
    for m in _RB_IMPORT.finditer(src.lined):
        if code[m.start() : m.start(2)].strip():
            wild = m[1] in ("include", "extend")
            out["imports"].append({"source": strip_quotes(m[2].strip()), "symbols": [], "is_wildcard": wild, "span": src.span(m.start(), m.end())})
    return out


def _rb_close(src: Source, node: dict, end: int, out: dict[str, list]) -> None:
    kw = node["kw"]
    if kw not in ("class", "module", "def"):
        return
    span = src.span(node["start"], end)
    if kw == "def":
        if node["owner"] is None:
            return
        m = re.match(r"\s*def\s+(self\.)?([\w?!=\[\]+*/<>%-]+)\s*(?:\(([^)]*)\)|[ \t]+([^\n;=]+))?", src.raw[node["start"] :])
        if m:
            node["owner"]["methods"].append({"name": m[2], "file": src.path, "span": span, "visibility": "public", "is_async": False, "is_static": bool(m[1]), "is_generator": False, "parameters": _rb_params(m[3] or m[4] or ""), "return_type": None, "decorators": [], "owner": node["owner"]["name"], "implements": None})
        return
    methods = sorted(node["methods"], key=lambda x: x["span"]["byte_range"]["start"])
    base = {"name": node["name"], "file": src.path, "span": span, "visibility": "public", "generics": []}
    if kw == "module":
        signatures = [{k: x[k] for k in ("name", "span", "is_async", "parameters", "return_type")} | {"has_default": True} for x in methods]
        out["interfaces"].append(base | {"extends": [], "methods": signatures, "properties": [], "language_kind": "module", "decorators": []})
    else:
        up = re.search(r"<\s*([\w:.]+)", node["line"])
        out["classes"].append(base | {"extends": up[1] if up else None, "implements": [], "methods": methods, "properties": [], "is_abstract": False, "decorators": []})
