"""Sources of files: directories, tables, and states of a source tree."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.runtime import ranked

# Defaults of a scan, artifact directories by language, and files whose conflicts show a broken state.
DEFAULT_EXCLUDES = ("**/node_modules/**", "**/target/**", "**/dist/**", "**/build/**", "**/.git/**", "**/vendor/**", "**/__pycache__/**")
ARTIFACTS = {
    "Rust": ("target",), "TypeScript": ("dist", "build", ".next"), "Java": ("target", "build"), "Kotlin": ("build",), "Scala": ("target",), "CSharp": ("bin", "obj"),
    "Swift": (".build",), "Cpp": ("build",), "Go": ("bin",), "Python": ("dist", "build"), "PHP": ("vendor",), "Ruby": ("pkg",),
}
ANY_ARTIFACT = ("target", "dist", "build", "bin", ".next")
LOCKS = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "poetry.lock")
MANY_CHANGES = 10


def ignore_pattern(lines: list[str]) -> tuple[str, str]:
    """(ignored, kept) regular expressions on paths from the root for the lines of an ignore file; '$^' where there is none."""
    out: tuple[list[str], list[str]] = ([], [])
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        body = line.lstrip("!").rstrip("/")
        anchored = "/" in body
        core = re.sub(r"(?<!\.)\.\*", "[^/]*", paths.glob_pattern(body.lstrip("/"))[1:-1]) if "**" not in body else paths.glob_pattern(body.lstrip("/"))[1:-1]
        out[keep].append(("^" if anchored else "(?:^|.*/)") + core + "(?:/.*)?$")
    return tuple("|".join(f"(?:{x})" for x in part) or "$^" for part in out)  # type: ignore[return-value]


def walk(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, language, content, content_hash, mtime, size) of the files below root in known languages, paths from the root.

    Hidden files and directories, and what the ignore lines name, are left out. Listing and reading are Spark's; contents are
    only read for files that pass. An empty directory gives no rows.
    """
    base = str(Path(root).resolve()) if "://" not in root else root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    bare = re.sub(r"^file:/*", "/", base)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(bare) + "/?", "")
    files = raw.select(path.alias("path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    ignored, kept = ignore_pattern(ignore or [])
    seen = files.where(~F.col("path").rlike(r"(?:^|/)\.[^/]")).where(~F.col("path").rlike(ignored) | F.col("path").rlike(kept))
    known = seen.where(paths.included(F.col("path"), include or [], exclude or [])).withColumn("language", paths.language(F.col("path"))).where("language is not null")
    if languages:
        known = known.where(F.col("language").isin(languages))
    return known.select("path", "language", "content", F.sha2("content", 256).alias("content_hash"), "mtime", "size")


def ignore_files(files: DataFrame, root: str, name: str = ".gitignore") -> DataFrame:
    """(path, content) of the ignore files in the directories of files and above, root being a folder that all executors see.

    Spark's own readers leave hidden files out, so each directory is asked by the task that has it; from a table, take the rows of that name.
    """
    dirs = files.select(F.explode(F.array_union(F.array(F.lit("")), paths.ancestors(paths.parent(F.col("path"))))).alias("dir")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f"{d}/{name}" if d else name, f.read_bytes()) for d in pdf["dir"] if (f := Path(root, d, name)).is_file()]
            yield pd.DataFrame(found, columns=["path", "content"])

    return dirs.mapInPandas(run, "path string, content binary")


def ignore_rules(ignoring: DataFrame) -> DataFrame:
    """(dir, ignored, kept) of ignore files (path, content): their directory, and regular expressions on paths from there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rules = [ignore_pattern(bytes(c or b"").decode("utf-8", "replace").splitlines()) for c in pdf["content"]]
            yield pd.DataFrame({"dir": pdf["dir"], "ignored": [r[0] for r in rules], "kept": [r[1] for r in rules]})

    return ignoring.select(paths.parent(F.col("path")).alias("dir"), "content").mapInPandas(run, "dir string, ignored string, kept string")


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path and more) that no ignore file in a directory above names; of several that speak about a file the deepest decides."""
    dirs = F.array_union(F.array(F.lit("")), paths.ancestors(paths.parent(F.col("path"))))
    above = files.select("path").distinct().withColumn("dir", F.explode(dirs))
    met = above.join(rules, "dir").withColumn("rest", F.when(F.col("dir") == "", F.col("path")).otherwise(F.substring("path", F.length("dir") + 2, F.length("path"))))
    keeps, drops = F.expr("rest rlike kept"), F.expr("rest rlike ignored")
    verdict = met.where(keeps | drops).groupBy("path").agg(F.max(F.struct(F.length("dir").alias("deep"), keeps.alias("kept"))).alias("v"))
    return files.join(verdict.where("not v.kept").select("path"), "path", "left_anti")


def in_walk_order(files: DataFrame) -> DataFrame:
    """files with walk_ord: their place when directories are walked in order of names, component by component."""
    return ranked(files, [F.asc(F.split("path", "/"))], "walk_ord")


def in_repositories(files: DataFrame) -> DataFrame:
    """A table of files of several repositories as one tree: path becomes repo/path."""
    return files.withColumn("path", F.concat_ws("/", "repo", "path"))


def slice_source(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (path, start, end, …) with source: the bytes from start up to end of the file, null beyond its end."""
    joined = spans.join(files.select("path", "content"), "path")
    inside = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.length("content"))
    cut = F.decode(F.substring("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")), "utf-8")
    return joined.withColumn("source", F.when(inside, cut)).drop("content")


def build_status(tree: DataFrame, language: str | None = None, uncommitted: int = 0) -> DataFrame:
    """One row (build_status) of a tree (path, mtime, content): unbuilt without artifacts, rebuild with many uncommitted changes,
    error with conflicts in a lock file or a source newer than all artifacts, else built."""
    dirs = ARTIFACTS.get(language or "", ANY_ARTIFACT)
    inside = F.col("path").rlike(r"(?:^|/)(?:" + "|".join(re.escape(d) for d in dirs) + ")/")
    lock = paths.name(F.col("path")).isin(*LOCKS) & F.col("content").cast("string").rlike(r"(?m)^(?:<{7}|>{7})")
    source = ~inside & paths.language(F.col("path")).isNotNull()
    sums = tree.agg(F.max(F.when(inside, F.col("mtime"))).alias("made"), F.max(F.when(source, F.col("mtime"))).alias("changed"), F.max(lock.cast("int")).alias("clash"))
    return sums.select(F.when(F.col("made").isNull(), "unbuilt").when(F.lit(uncommitted > MANY_CHANGES), "rebuild").when((F.col("clash") == 1) | (F.col("changed") > F.col("made")), "error").otherwise("built").alias("build_status"))


def find_config(start: str, name: str) -> Path | None:
    """The nearest file of that name in start or a directory above."""
    here = Path(start).resolve()
    return next((p / name for p in (here, *here.parents) if (p / name).is_file()), None)


def load_config(path: str | Path) -> dict:
    """include, exclude, languages, build status override and cache settings of a TOML file, with defaults for what it leaves out."""
    data = tomllib.loads(Path(path).read_text())
    scan, cache = data.get("scan", {}), data.get("cache", {})
    return {
        "include": list(scan.get("include", [])), "exclude": list(scan.get("exclude", DEFAULT_EXCLUDES)), "languages": list(scan.get("languages", [])),
        "build_status_override": scan.get("build_status"), "cache_enabled": bool(cache.get("enabled", True)), "cache_dir": cache.get("dir", ".cache"),
    }
