"""Session helpers every operator shares: lineage cuts, size checks, partition counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows a side may have to be broadcast, and to be worth it.
BROADCAST_ROWS = 20_000
#: Rows of one key that a task may get in a join; a key with more is split.
TASK_ROWS = 1_000_000


def session(app: str = "codeloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster the caller brings their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


#: What cut and stored have written and clean has not removed yet.
_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> int:
    """Remove all that cut and stored have written so far; how many places. Call it when the results of the queries so far are written."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: the lineage ends, and a lost executor loses nothing.

    Spark keeps its guess of a plan's size with the checkpoint, and a join's is the product of its sides': in a loop its digits
    double each round. So the rows written are read as a table of unknown size, and runtime statistics decide about joins.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    try:
        file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _WRITTEN.append(file.get())
        rows = done._jdf.queryExecution().toRdd()
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)
    except (AttributeError, TypeError, Py4JError):  # another version of Spark
        return done


def cut_loop(df: DataFrame) -> DataFrame:
    """cut for loops that unite tables: the number of partitions stays that of a shuffle."""
    return cut(df.coalesce(partitions(df.sparkSession)))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for stages that take far more work than their bytes suggest.

    A large input has them already and is left as it is; only a small one, of few files, is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read from there, so that several readers each take the columns they need."""
    place = f"{shared_dir(df.sparkSession).rstrip('/')}/codeloom-{uuid.uuid4().hex}"
    df.write.parquet(place)
    _WRITTEN.append(place)
    return df.sparkSession.read.parquet(place)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than that and one."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its row count was found to be within the bound, else df as it is."""
    return F.broadcast(df) if is_small(df, rows) else df


def lookup(left: DataFrame, right: DataFrame, keys: list[str], task_rows: int = TASK_ROWS, nulls: bool = True, heavy: DataFrame | None = None) -> DataFrame:
    """left with the columns of right, which has one row per key, or nulls; rows of left with a null key have none, and are left out without nulls.

    A key of more than task_rows rows of left is heavy. There are few of them, at most one per task_rows rows; their rows of
    right are broadcast if counted to be within the bound, so that no task gets all rows of a heavy key, else salted. The others are shuffled.
    heavy (keys, _salts) may be given where it is known.
    """
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    heavy = cut(heavy) if heavy is not None else cut(left.where(there).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > task_rows).select(*keys, F.ceil(F.col("_n") / task_rows).cast("int").alias("_salts")))
    added = [c for c in right.columns if c not in keys]
    columns = [*left.columns, *added]
    if heavy.isEmpty():
        rest, parts = left.where(there), []
    elif is_small(heavy):
        hot = F.broadcast(heavy.select(*keys))
        rest = left.where(there).join(hot, keys, "left_anti")
        parts = [left.join(hot, keys, "left_semi").join(F.broadcast(cut(right.join(hot, keys, "left_semi"))), keys, "left")]
    else:
        salted = left.where(there).join(heavy, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_salts"))).otherwise(0).cast("int")).drop("_salts")
        wide = right.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
        out = salted.join(wide, [*keys, "_salt"], "left").select(*columns)
        return out if not nulls else out.unionByName(left.where(~there).select(*left.columns, *[F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c in added]))
    out = rest.join(right, keys, "left").select(*columns)
    for part in parts:
        out = out.unionByName(part.select(*columns))
    return out if not nulls else out.unionByName(left.where(~there).select(*left.columns, *[F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c in added]))


def ordered_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with part: rows of a part stand before those of the next in the order, and equal ones lie in one part. Written, so that parts are final."""
    return cut(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("part", F.spark_partition_id()))


def ranked(df: DataFrame, order: list[Column], name: str = "i") -> DataFrame:
    """df with the place of each row in the whole order, from 0, without one task for all rows: parts of the order, their counts, places within."""
    parted = ordered_parts(df, order)
    counts = parted.groupBy("part").agg(F.count("*").alias("_n"))
    before = counts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))  # one row per partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parted.withColumn("_w", within).join(F.broadcast(before), "part").withColumn(name, F.col("_base") + F.col("_w")).drop("_base", "_w", "part")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: where their path does not hold it, Spark serves it to them as an archive."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    at_home = context.master.startswith("local[") and Path.cwd() == root
    if root in known or at_home or context.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="codeloom-")) / "codeloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sorted((root / "codeloom").rglob("*.py")):
            out.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
