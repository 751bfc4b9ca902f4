"""Splitting files over agents and writing their instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.runtime import ranked as number

# What the five agents look at.
CONCERNS = ("interfaces", "services", "methods", "decorators", "implementations")


def strategy(n_files: int) -> str:
    return "by_concern" if n_files < 500 else "hybrid" if n_files <= 2000 else "by_directory"


def focused(ir: DataFrame, text: str | None) -> DataFrame:
    """Files with an entity of whose name text is a part, in any case; all without a text."""
    if not text:
        return ir
    part = F.lit(text.lower())
    has = lambda column, name: F.exists(F.coalesce(F.col(column), F.array()), lambda x: F.contains(F.lower(x.getField(name)), part))
    fits = F.lit(False)
    for column in ("interfaces", "services", "classes", "functions", "schemas", "type_aliases"):
        fits |= has(column, "name")
    return ir.where(fits | has("implementations", "target"))


def concern_flags(hybrid: bool = False) -> list[Column]:
    """Whether a file belongs to each concern; in the mixed strategy decorated interfaces do not make one."""
    some = lambda column: F.size(column) > 0
    marked = lambda column: F.exists(F.coalesce(F.col(column), F.array()), lambda x: F.size(x.getField("decorators")) > 0)
    decorated = marked("classes") | marked("services") | (F.lit(False) if hybrid else marked("interfaces"))
    return [some("interfaces"), some("services"), some("classes") | some("functions"), decorated, some("implementations")]


def by_concern(ir: DataFrame, agents: int = 5) -> DataFrame:
    """(agent, concern, path, build_status): one row per file and concern it has; a file may have several."""
    flags = concern_flags()[: min(agents, len(CONCERNS))]
    which = F.array(*[F.when(f, F.struct(F.lit(i + 1).alias("agent"), F.lit(CONCERNS[i]).alias("concern"))) for i, f in enumerate(flags)])
    return ir.select("path", "build_status", F.inline(F.filter(which, lambda x: x.isNotNull()))).select("agent", "concern", "path", "build_status")


def top_directory(path: Column) -> Column:
    """First component of a path from the root; '.' for a bare file."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def slices(files: DataFrame, agents: int = 5) -> DataFrame:
    """(agent, directory): top directories in order, cut into as many stretches as there are agents."""
    dirs = files.select(top_directory(F.col("path")).alias("directory")).distinct()
    counted = dirs.agg(F.count("*").alias("n"))
    ranked = number(dirs, [F.asc("directory")]).join(F.broadcast(counted))  # a single row
    # agent k (from 0) has the places from floor(n k / a) to floor(n (k + 1) / a)
    agent = F.floor(((F.col("i") + 1) * agents - 1) / F.col("n")) + 1
    return ranked.select(agent.cast("int").alias("agent"), "directory")


def round_robin(files: DataFrame, agents: int = 5) -> DataFrame:
    """(agent, directory, n_files): top directories by falling number of files, dealt in turn."""
    dirs = files.groupBy(top_directory(F.col("path")).alias("directory")).agg(F.count("*").alias("n_files"))
    rank = F.col("i")
    return number(dirs, [F.desc("n_files"), F.asc("directory")]).select((F.pmod(rank, F.lit(max(agents, 1))) + 1).cast("int").alias("agent"), "directory", "n_files")


def by_directory(files: DataFrame, agents: int = 5) -> DataFrame:
    """(agent, directory, path, build_status): the files of the directories that round_robin deals to each agent."""
    dealt = round_robin(files, agents).select("agent", "directory")
    return files.withColumn("directory", top_directory(F.col("path"))).join(dealt, "directory").select("agent", "directory", "path", "build_status")


def hybrid(ir: DataFrame, agents: int = 5) -> DataFrame:
    """(agent, concern, path, build_status): top directories in stretches over the agents, each with its concern.

    An agent that gets no directory gets the files of its concern instead; decorated interfaces alone make none here.
    """
    count = min(agents, len(CONCERNS))
    dealt = slices(ir, count)
    title = F.element_at(F.array(*[F.lit(c) for c in CONCERNS]), F.col("agent"))
    out = ir.withColumn("directory", top_directory(F.col("path"))).join(dealt, "directory").select("agent", title.alias("concern"), "path", "build_status")
    busy = {r["agent"] for r in dealt.select("agent").distinct().collect()}  # at most as many rows as there are concerns
    for i, fits in enumerate(concern_flags(hybrid=True)[:count]):
        if i + 1 not in busy:
            out = out.unionByName(ir.where(fits).select(F.lit(i + 1).alias("agent"), F.lit(CONCERNS[i]).alias("concern"), "path", "build_status"))
    return out


def directories(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, directories): the sorted distinct directories of files, joined."""
    return files.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(paths.parent(F.col("path")))), ", ").alias("directories"))


def by_status(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, built_files, other_files): numbers of files that are built and that are not."""
    built = F.count_if(F.col("build_status") == "built")
    return files.groupBy(*keys).agg(built.alias("built_files"), (F.count("*") - built).alias("other_files"))


def prompt(assignments: DataFrame, title: str, totals: dict[str, int]) -> str:
    """Markdown for the agents: one section each; assignments (agent, concern, path, build_status) are summed up before they are read."""
    per = by_status(assignments, ["agent", "concern"]).join(directories(assignments, ["agent", "concern"]), ["agent", "concern"]).orderBy("agent").collect()
    lines = [f"# {title}", "", "## Overview", ""] + [f"- {k}: {v}" for k, v in totals.items()] + [""]
    for r in per:
        lines += [f"## Agent {r['agent']}: {r['concern']}", "", f"Directories: {r['directories']}", f"Built files: {r['built_files']}", f"Files to look at: {r['other_files']}", ""]
    return "\n".join(lines)
