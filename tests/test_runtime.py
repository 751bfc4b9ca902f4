"""Session helpers: joins that split heavy keys, places in an order, and what is removed afterwards."""

import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom import runtime


@pytest.mark.parametrize(("task_rows", "few"), [(1_000_000, True), (20, True), (20, False)])
def test_lookup(spark, task_rows, few, monkeypatch):
    monkeypatch.setattr(runtime, "is_small", lambda df, rows=0: few)
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, "hot", "hot", "hot", *map(str, range(9))]), rnd.choice([1, 1, None])) for i in range(300)]
    left = spark.createDataFrame(rows, "n long, a string, b int")
    right = spark.createDataFrame([(x, 1, x * 2) for x in ["hot", "1", "2", "77"]] + [("hot", 2, "no")], "a string, b int, v string")
    known = {("hot", 1): "hothot", ("1", 1): "11", ("2", 1): "22"}
    got = sorted(tuple(r) for r in runtime.lookup(left, right, ["a", "b"], task_rows).select("n", "a", "b", "v").collect())
    assert got == sorted(((n, a, b, known.get((a, b))) for n, a, b in rows), key=lambda r: r[0])
    some = runtime.lookup(left, right, ["a", "b"], task_rows, nulls=False).count()
    assert some == sum(1 for _, a, b in rows if a is not None and b is not None)


def test_ranked_with_ties(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    got = {(r["a"], r["id"]): r["i"] for r in runtime.ranked(rows, [F.desc("a"), F.asc("id")]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got, key=lambda x: (-x[0], x[1])))}
    assert runtime.ranked(rows.limit(0), [F.asc("id")]).count() == 0


def test_clean_removes_what_was_written(spark):
    runtime.clean(spark)
    made = runtime.stored(spark.range(5)), runtime.cut(spark.range(7))
    assert [x.count() for x in made] == [5, 7]
    places = [p.removeprefix("file:") for p in runtime._WRITTEN]
    assert len(places) == 2 and all(map(os.path.exists, places))
    assert runtime.clean(spark) == 2 and not any(map(os.path.exists, places))


def test_cuts_in_a_loop_stay_quick(spark):
    """A plan's guessed size must not grow with the rounds."""
    import time

    table = runtime.cut(spark.range(20).select("id", (F.col("id") + 1).alias("up")))
    times = []
    for _ in range(14):
        began = time.time()
        far = table.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        table = runtime.cut_loop(table.join(far, "up", "left").select("id", F.coalesce("up2", "up").alias("up")))
        times.append(time.time() - began)
    assert max(times[-3:]) < 20 * min(times)
