"""References to records that do not exist at the time of the reference.

A reference is (ref_table, ref_field, manifest_id, source_key, ref_value, t); a target is a key with the spans in which it
exists. References are pre-aggregated per key and month, with their number and their first and last time, before anything
is joined. A group that one span covers is live, one that no span meets is dead; only groups in whose time a span begins or
ends are looked at reference by reference. Groups come back to their references by a split join: keys with more references
than a task should get are heavy, their groups are broadcast if few enough, else salted by their size; the other keys are
shuffled. The orphans of both are united.

Defined cases. A null or empty value is no reference. A null scope or a null time matches no target, so such a reference
is an orphan; it is taken out before any join. A null end means that the target still exists; a target without a start never
exists. Repeated rows count once. Empty tables give an empty result, or all references as orphans where only the targets are missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import TASK_ROWS, broadcast_if_small, cut, lookup


def references(subsystems: DataFrame, entities: DataFrame) -> DataFrame:
    """All references of the two tables, as rows (ref_table, ref_field, manifest_id, source_key, ref_value, t)."""
    shape = lambda table, field, key, value, t: [F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), "manifest_id", F.col(key).cast("string").alias("source_key"), value.alias("ref_value"), F.col(t).alias("t")]
    parts = [
        subsystems.select(shape("subsystems", "dependencies", "id", F.explode("dependencies"), "synced_at")),
        subsystems.select(shape("subsystems", "domain", "id", F.col("domain"), "synced_at")),
        entities.select(shape("entity_summaries", "subsystem_id", "entity_id", F.col("subsystem_id"), "scanned_at")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("ref_value is not null and ref_value <> ''")


def targets(subsystems: DataFrame, domains: DataFrame) -> DataFrame:
    """(target, manifest_id, ref_value, since, until): the spans in which subsystems and domains exist."""
    a = subsystems.select(F.lit("subsystem").alias("target"), "manifest_id", F.col("id").alias("ref_value"), F.col("registered_at").alias("since"), F.col("deleted_at").alias("until"))
    b = domains.select(F.lit("domain").alias("target"), "manifest_id", F.col("domain_id").alias("ref_value"), F.col("registered_at").alias("since"), F.col("deleted_at").alias("until"))
    return a.unionByName(b).where("manifest_id is not null and ref_value is not null and since is not null").distinct()


def _target_of(refs: DataFrame) -> DataFrame:
    return refs.withColumn("target", F.when(F.col("ref_field") == "domain", "domain").otherwise("subsystem"))


KEY = ["target", "manifest_id", "ref_value"]
GROUP = [*KEY, "month"]


def _groups(refs: DataFrame) -> DataFrame:
    """Per key and month: n references, the first and the last time."""
    return refs.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def states(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """groups with state 'dead' or 'mixed'; the live ones, all of whose references lie in one span, are left out."""
    key = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in KEY])
    open_after = lambda t: F.col("s.until").isNull() | (F.col("s.until") > F.col(t))
    covered = key("g", "s") & (F.col("s.since") <= F.col("g.first")) & open_after("g.last")
    met = key("g", "s") & (F.col("s.since") <= F.col("g.last")) & open_after("g.first")
    rest = cut(groups.alias("g").join(spans.alias("s"), covered, "left_anti"))
    mixed = rest.alias("g").join(spans.alias("s"), met, "left_semi").withColumn("state", F.lit("mixed"))
    return mixed.unionByName(rest.alias("g").join(spans.alias("s"), met, "left_anti").withColumn("state", F.lit("dead")))


def dead(refs: DataFrame, spans: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Of refs (target, manifest_id, ref_value, t, n and more) the rows whose target does not exist at t.

    n says how many references a row of refs stands for.
    """
    known = F.col("manifest_id").isNotNull() & F.col("t").isNotNull()
    live = refs.where(known).withColumn("month", F.date_format("t", "yyyy-MM"))
    found = cut(states(_groups(live), spans).select(*GROUP, "n", "state"))
    heavy = found.where(F.col("n") > task_rows).select(*GROUP, F.ceil(F.col("n") / task_rows).cast("int").alias("_salts"))
    marked = lookup(live, found.select(*GROUP, "state"), GROUP, task_rows, nulls=False, heavy=heavy).where("state is not null")
    covers = reduce(lambda x, y: x & y, [F.col(f"k.{c}") == F.col(f"s.{c}") for c in KEY]) & (F.col("s.since") <= F.col("k.t")) & (F.col("s.until").isNull() | (F.col("s.until") > F.col("k.t")))
    of_mixed = spans.join(found.where("state = 'mixed'").select(*KEY).distinct(), KEY, "left_semi")
    gone = marked.alias("k").join(broadcast_if_small(cut(of_mixed)).alias("s"), covers, "left_anti")  # no span meets a dead group
    return gone.select(*refs.columns).unionByName(refs.where(~known))


def orphans(subsystems: DataFrame, domains: DataFrame, entities: DataFrame) -> DataFrame:
    """(ref_table, ref_field, manifest_id, source_key, ref_value): each distinct reference whose target did not exist at its time."""
    refs = references(subsystems, entities).withColumn("n", F.lit(1).cast("long"))
    gone = dead(_target_of(refs), targets(subsystems, domains))
    return gone.select("ref_table", "ref_field", "manifest_id", "source_key", "ref_value").distinct()


def orphan_report(subsystems: DataFrame, domains: DataFrame, entities: DataFrame) -> DataFrame:
    """(ref_table, ref_field, month, references, orphans, orphan_rate) per table, field and month of the reference.

    Repeated rows count once. Only counts per key and time are checked, so the sources are never joined.
    """
    refs = references(subsystems, entities).distinct()
    keyed = cut(_target_of(refs).groupBy("ref_table", "ref_field", *KEY, "t").agg(F.count("*").alias("n")))
    month = F.date_format("t", "yyyy-MM").alias("month")
    gone = dead(keyed, targets(subsystems, domains)).withColumn("lost", F.col("n"))
    both = keyed.withColumn("lost", F.lit(0).cast("long")).unionByName(gone.withColumn("n", F.lit(0).cast("long")))
    sums = both.groupBy("ref_table", "ref_field", month).agg(F.sum("n").alias("n_references"), F.sum("lost").alias("n_orphans"))
    return sums.withColumn("orphan_rate", F.round(F.col("n_orphans") / F.col("n_references"), 6))
