"""Path columns. Paths compare by component, not by character: src/auth is no prefix of src/authz."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by language.
EXTENSIONS = {
    "TypeScript": ("ts", "tsx", "js", "jsx", "mjs", "cjs"), "Python": ("py", "pyi"), "Rust": ("rs",), "Go": ("go",), "Java": ("java",), "Kotlin": ("kt", "kts"),
    "CSharp": ("cs",), "Swift": ("swift",), "PHP": ("php",), "Ruby": ("rb",), "Scala": ("scala", "sc"), "Cpp": ("cpp", "cc", "cxx", "hpp", "hxx", "h"),
}


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null for none and for names that only start with a dot."""
    found = F.regexp_extract(name(path), r"^.+\.([^.]+)$", 1)
    return F.when(found != "", found)


def language(path: Column) -> Column:
    """The language an extension stands for, case-sensitive; null for others."""
    table = F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for e in v for x in (e, k)])
    return table[extension(path)]


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def parent(path: Column) -> Column:
    """Everything before the last slash; '' for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def trimmed(path: Column) -> Column:
    """Without trailing slashes, without . components past the first."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), r"(?<=.)(?:/\.)?/*$", ""), r"/+", "/")


def has_prefix(path: Column, prefix: Column) -> Column:
    """Whether the components of prefix are the first ones of path; an empty prefix fits all."""
    p = trimmed(prefix)
    return (p == "") | (path == p) | F.startswith(path, F.when(p == "/", p).otherwise(F.concat(p, F.lit("/"))))


def depth(path: Column) -> Column:
    """Number of components, the root being one."""
    p = trimmed(path)
    return F.when(p == "", 0).when(p == "/", 1).otherwise(F.size(F.split(p, "/")))


def ancestors(path: Column) -> Column:
    """The path itself and all directories above it, shortest first; of an absolute path the root too."""
    parts = F.split(path, "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.transform(made, lambda p: F.when(p == "", "/").otherwise(p))


def normalized(path: Column, keep_above: bool = False) -> Column:
    """Without . and .. components; .. at the top is dropped, or kept with keep_above."""

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        up = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)) if keep_above else done)
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), joined)).otherwise(joined)


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob in which * also crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] == "!" else inner) + "]", end + 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_pattern(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def is_glob(text: Column) -> Column:
    return text.rlike(r"[*?\[{]")


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path fits any include glob, or there is none, and no exclude glob."""
    fits = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
    return (F.lit(True) if not include else fits(include)) & ~fits(exclude)
