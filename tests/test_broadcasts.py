"""Tables over many files are never broadcast because Spark guesses them small."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import bootstrap, resolve, tables

FILES = 400


@pytest.fixture(scope="module")
def ir(spark, tmp_path_factory):
    """Records as stored: file i imports ./f<i + 1>, and f0, which all import."""
    n = F.col("id")
    name = lambda k: F.concat(F.lit("f"), k.cast("string"))
    at = {
        "path": F.concat(F.lit("repo/part"), (n % 7).cast("string"), F.lit("/src/"), name(n), F.lit(".ts")),
        "imports": F.array(
            F.named_struct(F.lit("source"), F.concat(F.lit("./"), name(n + 7)), F.lit("symbols"), F.array(F.named_struct(F.lit("name"), F.lit("X"), F.lit("alias"), F.lit(None).cast("string"), F.lit("is_default"), F.lit(False), F.lit("is_namespace"), F.lit(False))), F.lit("is_wildcard"), F.lit(False)),
            F.named_struct(F.lit("source"), F.lit("part0/f0"), F.lit("symbols"), F.array(F.named_struct(F.lit("name"), F.lit("I"), F.lit("alias"), F.lit(None).cast("string"), F.lit("is_default"), F.lit(False), F.lit("is_namespace"), F.lit(False))), F.lit("is_wildcard"), F.lit(False)),
        ),
    }
    place = str(tmp_path_factory.mktemp("ir") / "ir")
    spark.range(FILES).select(at["path"].alias("path"), at["imports"].alias("imports")).write.parquet(place)
    return spark.read.parquet(place)


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_imports_are_resolved_without_broadcast(ir):
    """walked_imports_resolved"""
    out = resolve.resolve_imports(tables.imports(ir), resolve.path_index(ir))
    assert broadcasts(out) == 0
    rows = {(r["file"], r["source"]): r["resolved_path"] for r in out.collect()}
    assert len(rows) == 2 * FILES
    for i in range(FILES):
        to = f"repo/part{i % 7}/src/f{i + 7}.ts" if i + 7 < FILES else None
        assert rows[f"repo/part{i % 7}/src/f{i}.ts", f"./f{i + 7}"] == to
        assert rows[f"repo/part{i % 7}/src/f{i}.ts", "part0/f0"] is None


def test_links_are_made_without_broadcast(ir):
    """walked_links"""
    imports = resolve.resolve_imports(tables.imports(ir), resolve.path_index(ir))
    edges = ir.select(F.concat(F.lit("X"), F.substring("path", 1, 0)).alias("interface_name"), F.concat(F.lit("C"), F.hash("path")).alias("implementor"), F.col("path").alias("impl_file"))
    out = resolve.implementation_links(edges, ir.select(F.concat(F.lit("I"), "path").alias("name"), F.col("path").alias("file")), imports)
    assert broadcasts(out) == 0
    rows = {r["impl_file"]: r["interface_file"] for r in out.collect()}
    assert rows == {f"repo/part{i % 7}/src/f{i}.ts": f"repo/part{i % 7}/src/f{i + 7}.ts" if i + 7 < FILES else None for i in range(FILES)}


def test_connections_broadcast_no_files(ir, monkeypatch):
    """walked_connections: subsystems counted to be too many are not broadcast, and directories of files never."""
    files = ir.select("path")
    known = ir.sparkSession.createDataFrame([(f"s{k}", f"part{k}", f"repo/part{k}", k) for k in range(7)], "id string, name string, file_path string, ord int")
    imports = tables.imports(ir).select("file", "source")
    want = [("s%d" % k, "s0", len(range(k, FILES, 7))) for k in range(1, 7)]
    for few in (True, False):
        monkeypatch.setattr(bootstrap, "is_small", lambda df, few=few: few)
        placed = bootstrap.path_subsystem(files, known)
        assert broadcasts(placed) == few and placed.count() == FILES
        links = bootstrap.connections(files, imports, known)
        assert sorted((r["from"], r["to"], r["weight"]) for r in links.collect()) == want
    plan = bootstrap.path_subsystem(files, known)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
