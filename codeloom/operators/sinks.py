"""Output: field masks as nested projections, JSON, NDJSON, CSV, Markdown and text tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_mask(mask: str) -> dict:
    """The tree of a comma list of dotted paths; a path that is both a leaf and has children keeps its children only."""
    tree: dict = {}
    for path in filter(None, (p.strip() for p in mask.split(","))):
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})
    return tree


def _masked(column: Column, kind: T.DataType, tree: dict) -> Column:
    if not tree:
        return column
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _masked(x, kind.elementType, tree))
    if isinstance(kind, T.StructType):
        parts = [_masked(column.getField(f.name), f.dataType, tree[f.name]).alias(f.name) for f in kind.fields if f.name in tree]
        return F.when(column.isNotNull(), F.struct(*parts)) if parts else F.when(column.isNotNull(), F.struct())
    return column


def apply_mask(df: DataFrame, mask: str) -> DataFrame:
    """df with only the fields of a mask, so that a Parquet scan reads no others; an unknown top field is an error, an unknown inner one is left out."""
    tree = parse_mask(mask)
    unknown = sorted(set(tree) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown fields {', '.join(unknown)}; valid are {', '.join(df.columns)}")
    return df.select(*[_masked(F.col(f.name), f.dataType, tree[f.name]).alias(f.name) for f in df.schema.fields if f.name in tree])


def sorted_fields(kind: T.DataType, column: Column) -> Column:
    """A column with the fields of all structs in alphabetical order, as in rendered JSON."""
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: sorted_fields(kind.elementType, x))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[sorted_fields(f.dataType, column.getField(f.name)).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    return column


def json_lines(df: DataFrame) -> DataFrame:
    """(value): one compact JSON object per row, keys in alphabetical order, nulls kept."""
    return df.select(F.to_json(F.struct(*[sorted_fields(f.dataType, F.col(f.name)).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]), {"ignoreNullFields": "false"}).alias("value"))


def write_ndjson(df: DataFrame, folder: str) -> None:
    json_lines(df).write.mode("overwrite").text(folder)


def pretty_json(df: DataFrame) -> str:
    """A JSON array for people; for results of a size that people read."""
    return json.dumps([json.loads(r["value"]) for r in json_lines(df).toLocalIterator()], indent=2, ensure_ascii=False)


def _quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(column, '"', '""'), F.lit('"'))


def csv_lines(entities: DataFrame) -> DataFrame:
    """(line): name and file in quotes, then kind, line, language and build status with a capital letter."""
    word = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1000))
    kind = F.array_join(F.transform(F.split("kind", "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")
    return entities.select(F.concat_ws(",", _quoted(F.col("name")), kind, _quoted(F.col("file")), F.coalesce(F.col("line").cast("string"), F.lit("")), "language", word(F.col("build_status"))).alias("line"))


def markdown_lines(entities: DataFrame) -> DataFrame:
    """(line): a table row per entity."""
    return entities.select(F.concat(F.lit("| "), F.concat_ws(" | ", "name", "kind", "file", F.coalesce(F.col("line").cast("string"), F.lit("")), "language", "build_status"), F.lit(" |")).alias("line"))


def compact(totals: dict) -> str:
    return " ".join(f"{k}={v}" for k, v in totals.items())


def text_table(df: DataFrame, rows: int = 1000) -> str:
    """Aligned columns for a terminal; a last line says so where there are more than so many rows."""
    found = df.limit(rows + 1).collect()
    data = [df.columns] + [["" if v is None else str(v) for v in r] for r in found[:rows]]
    widths = [max(len(r[i]) for r in data) for i in range(len(df.columns))]
    more = [f"... more than {rows} rows"] if len(found) > rows else []
    return "\n".join(["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in data] + more)


def table_lines(df: DataFrame) -> DataFrame:
    """(value): all rows as aligned columns, without the driver; the widths come from one aggregate."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    rows = df.select(*text)
    widths = rows.agg(*[F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(f"w_{i}") for i, c in enumerate(df.columns)])
    padded = [F.rpad(F.col(c), F.col(f"w_{i}"), F.lit(" ")) for i, c in enumerate(df.columns)]
    return rows.join(F.broadcast(widths)).select(F.rtrim(F.concat_ws("  ", *padded)).alias("value"))


def write_single(df: DataFrame, path: str, form: str) -> None:
    """One file in the form json (an array), ndjson, csv, markdown or table, for results of a size that people read."""
    makers = {"ndjson": lambda: json_lines(df), "table": lambda: table_lines(df), "csv": lambda: csv_lines(df), "markdown": lambda: markdown_lines(df)}
    if form == "json":
        return write_text(pretty_json(df), path)
    if form not in makers:
        raise ValueError(f"unknown form {form!r}; known are json, {', '.join(makers)}")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        for row in makers[form]().toLocalIterator():
            out.write(row[0] + "\n")


def write_text(text: str, path: str) -> None:
    """Write a text, making the directories above it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def resolve_format(asked: str | None, terminal: bool) -> str:
    return asked or ("table" if terminal else "json")


def slashes(df: DataFrame, column: str = "file_path") -> DataFrame:
    """Paths of a manifest with / only."""
    return df.withColumn(column, F.replace(F.col(column), F.lit("\\"), F.lit("/")))


def language_stats(counts: DataFrame) -> DataFrame:
    """(language, n_files) by falling number, then by name."""
    return counts.orderBy(F.desc("n_files"), "language")
