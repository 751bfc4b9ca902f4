"""Filling windows of fixed capacity with documents, in the proportions of a mix of sources.

Deficit round-robin over one queue per source fills each window: at each window every source earns its share of
the capacity, the source that lacks most gives its largest document that still fits, and what a source lacks or has
over is carried to the next window. Documents are spread over shards of bounded size; how far each source will be
behind or ahead at the start of a shard follows from the totals of the shards before it, so deficits also carry across
shards without running them one after the other. Pieces of long documents fill windows of their own; they are charged to their
source before the shard they belong to starts. Windows that a shard leaves badly filled are opened again and packed
together in fewer shards, with the deficits that all closed windows have left, until one shard is left or nothing is gained.
All documents are laid out, so the mix holds as long as every source still has documents; report and shares say how far it does.

Items are numbered by document, text and copy, so windows depend neither on cores nor on files.

Defined cases. Null and empty texts have no tokens and take no place. A document is cut only if it alone exceeds the
capacity: into full windows and one rest. Sources without a share, the null source among them, are used to fill gaps.
Repeated rows are packed each for itself. No documents or no windows give an empty result; a capacity below one is an error.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import tokens as T
from codeloom.runtime import cut

#: Tokens and documents of a shard, which is packed in one task.
SHARD_TOKENS, SHARD_DOCS = 6_000_000, 60_000
#: Windows below this share of their capacity are opened again.
WELL_FILLED = 0.97
#: Shards that one shard of the next round takes over, at least.
FAN_IN = 16
#: Rows that the tables of windows and of sources may have; both are read into the driver.
MAX_CONFIG = 10_000

_PLACED = "window_name string, round int, shard long, seq long, slot int, item string, doc_id long, source string, start long, end long, fill double"


class Queue:
    """Documents of one source by size."""

    def __init__(self) -> None:
        self.by_size: dict[int, list[int]] = {}
        self.order: list[int] = []
        self.left = 0

    def add(self, size: int, row: int) -> None:
        rows = self.by_size.setdefault(size, [])
        if not rows:
            insort(self.order, size)
        rows.append(row)
        self.left += 1

    def take(self, room: int) -> tuple[int, int] | None:
        """The largest document of at most room tokens."""
        at = bisect_right(self.order, room) - 1
        if at < 0:
            return None
        size = self.order[at]
        row = self.by_size[size].pop()
        if not self.by_size[size]:
            del self.order[at]
        self.left -= 1
        return size, row


def pack(sizes: list[int], sources: list[str | None], capacity: int, shares: dict[str, float], deficits: dict[str, float]) -> list[list[int]]:
    """Windows as lists of row numbers; deficits says what each source lacks at the start."""
    queues: dict[str | None, Queue] = {}
    for row in sorted(range(len(sizes)), reverse=True):
        queues.setdefault(sources[row], Queue()).add(sizes[row], row)
    lack = {s: deficits.get(s, 0.0) if s in shares else 0.0 for s in queues}
    windows: list[list[int]] = []
    while live := [s for s, q in queues.items() if q.left]:
        earning = sum(shares.get(s, 0.0) for s in live)
        for s in live:
            lack[s] += capacity * shares.get(s, 0.0) / earning if earning else 0.0
        room, rows = capacity, []
        while True:
            for s in sorted(live, key=lambda s: (shares.get(s, 0.0) == 0, -lack[s], s or "")):
                if found := queues[s].take(room):
                    break
            else:
                break
            size, row = found
            rows.append(row)
            room -= size
            lack[s] -= size
        windows.append(rows)
    return windows


def _shard(number: int, shards: dict[str, int]) -> Column:
    many = F.create_map(*[F.lit(x) for pair in shards.items() for x in pair])
    return F.pmod(F.xxhash64("item", "start", F.lit(number)), F.coalesce(many[F.col("window_name")], F.lit(1))).cast("long")


def _gaps(totals: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(window_name, shard, source, gap): what each source of the mix lacks in a shard of totals (window_name, shard, source, supply)."""
    share = F.create_map(*[F.lit(x) for pair in (shares or {"": 0.0}).items() for x in pair])
    # one row per shard and source with a share, also where the source has nothing in the shard
    every = totals.groupBy("window_name", "shard").agg(F.sum("supply").alias("whole")).withColumn("source", F.explode(F.array(*[F.lit(s) for s in shares] or [F.lit("")])))
    return every.join(totals, ["window_name", "shard", "source"], "left").select("window_name", "shard", "source", (F.col("whole") * F.coalesce(share[F.col("source")], F.lit(0.0)) - F.coalesce("supply", F.lit(0))).alias("gap"))


def _round(items: DataFrame, windows: list[tuple[str, int]], shares: dict[str, float], number: int, shards: dict[str, int], prior: DataFrame) -> DataFrame:
    """Pack items (window_name, item, doc_id, source, start, end) once, in so many shards per window.

    prior (window_name, shard, source, supply) is what closed windows hold, before each shard starts; shard -1 is before all.
    """
    cut_items = items.withColumn("size", F.col("end") - F.col("start")).withColumn("shard", _shard(number, shards))
    totals = cut_items.groupBy("window_name", "shard", "source").agg(F.sum("size").alias("supply"))
    before = Window.partitionBy("window_name", "source").orderBy("shard", "own").rowsBetween(Window.unboundedPreceding, -1)
    both = _gaps(prior, shares).withColumn("own", F.lit(0)).unionByName(_gaps(totals, shares).withColumn("own", F.lit(1)))
    start = both.withColumn("deficit", F.coalesce(F.sum("gap").over(before), F.lit(0.0))).where("own = 1")
    start = start.groupBy("window_name", "shard").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "deficit")))).alias("deficits"))  # one entry per source of the mix
    capacities = dict(windows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "start"], kind="stable").reset_index(drop=True)
        name, shard = pdf["window_name"].iloc[0], int(pdf["shard"].iloc[0])
        sources = [None if pd.isna(s) else s for s in pdf["source"]]
        sizes = pdf["size"].tolist()
        packed = pack(sizes, sources, capacities[name], shares, json.loads(pdf["deficits"].iloc[0] or "{}"))
        rows = [(row, seq, slot, sum(sizes[x] for x in window) / capacities[name]) for seq, window in enumerate(packed) for slot, row in enumerate(window)]
        order, seqs, slots, fills = zip(*rows) if rows else ((), (), (), ())
        out = pdf.iloc[list(order)][["window_name", "item", "doc_id", "source", "start", "end"]].reset_index(drop=True)
        out["round"], out["shard"], out["seq"], out["slot"], out["fill"] = number, shard, seqs, slots, fills
        return out[[x.split(" ")[0] for x in _PLACED.split(", ")]]

    return cut_items.join(start, ["window_name", "shard"]).groupBy("window_name", "shard").applyInPandas(run, _PLACED)


def _shards(items: DataFrame, names: list[str], before: dict[str, int] | None, shard_tokens: int, shard_docs: int) -> dict[str, int]:
    found = {r["window_name"]: (r["t"], r["n"]) for r in items.groupBy("window_name").agg(F.sum(F.col("end") - F.col("start")).alias("t"), F.count("*").alias("n")).collect()}
    need = {x: max(1, -(-found[x][0] // shard_tokens), -(-found[x][1] // shard_docs)) for x in names if x in found}
    return {x: int(min(n, max(1, before[x] // FAN_IN)) if before and n <= max(1, before[x] // FAN_IN) else n) for x, n in need.items()}


def windows(
    documents: DataFrame, context_windows: DataFrame, source_mix: DataFrame, vocabulary: str = T.VOCABULARY, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """(window_name, window_id, slot, doc_id, source, start_token, end_token): which tokens of which document lie in which window."""
    config = context_windows.select("window_name", "capacity_tokens").where("window_name is not null").distinct().limit(MAX_CONFIG + 1).collect()
    mix = source_mix.select("source", "target_share").where("source is not null and target_share > 0").limit(MAX_CONFIG + 1).collect()
    if len(config) > MAX_CONFIG or len(mix) > MAX_CONFIG:
        raise ValueError(f"more than {MAX_CONFIG} windows or sources")
    caps = [(r["window_name"], int(r["capacity_tokens"] or 0)) for r in config]
    if any(c < 1 for _, c in caps):
        raise ValueError("a window needs a capacity of at least one token")
    shares = {r["source"]: float(r["target_share"]) for r in mix}
    sized = T.sizes(documents, vocabulary).where("tokens > 0").groupBy("doc_id", "source", "digest", "tokens").agg(F.count("*").alias("n"))
    text_key = F.substring(F.sha2(F.concat_ws("|", "digest", F.coalesce("source", F.lit("\0"))), 256), 1, 16)
    copies = sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    base = cut(copies.select(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_key, "copy").alias("item"), "doc_id", "source", "tokens"))
    if not caps:
        caps = [("", 1)]
        base = base.limit(0)
    each = base.withColumn("w", F.explode(F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).cast("long").alias("cap")) for n, c in caps]))).select("item", "doc_id", "source", "tokens", "w.window_name", "w.cap")
    items = each.where("tokens % cap > 0").select("window_name", "item", "doc_id", "source", (F.col("tokens") - F.col("tokens") % F.col("cap")).alias("start"), F.col("tokens").alias("end"))
    number, shards = 0, _shards(items, [n for n, _ in caps], None, shard_tokens, shard_docs)
    whole = each.where("tokens >= cap").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("tokens div cap") - 1)))
    whole = whole.select("window_name", "item", "doc_id", "source", (F.col("k") * F.col("cap")).alias("start"), ((F.col("k") + 1) * F.col("cap")).alias("end")).withColumn("shard", _shard(0, shards or {caps[0][0]: 1}))
    full = whole.select("window_name", F.lit(-1).alias("round"), "shard", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("slot"), "item", "doc_id", "source", "start", "end", F.lit(1.0).alias("fill"))
    held = lambda rows, shard: rows.groupBy("window_name", shard, "source").agg(F.sum(F.col("end") - F.col("start")).alias("supply"))
    first = F.lit(-1).cast("long").alias("shard")
    prior = cut(held(full, F.col("shard")))  # a few numbers per shard and source
    out, previous = full, None
    while shards:
        placed = cut(_round(items, caps, shares, number, shards, prior))
        last = shards == previous  # no fewer shards than before: nothing is gained by another round
        open_again = F.col("fill") < WELL_FILLED
        alone = [n for n, k in shards.items() if k == 1]
        keep = ~open_again | F.col("window_name").isin(alone) | F.lit(last)
        out = out.unionByName(placed.where(keep))
        items = placed.where(~keep).select("window_name", "item", "doc_id", "source", "start", "end")
        prior = cut(prior.select("window_name", first, "source", "supply").unionByName(held(placed.where(keep), first)).groupBy("window_name", "shard", "source").agg(F.sum("supply").alias("supply")))
        number += 1
        previous, shards = shards, _shards(items, [n for n, _ in caps], shards, shard_tokens, shard_docs)
    window_id = F.when(F.col("round") < 0, F.concat_ws("-", F.lit("w"), "item", "start")).otherwise(F.concat_ws("-", "round", "shard", "seq"))
    return out.select("window_name", window_id.alias("window_id"), "slot", "doc_id", "source", F.col("start").alias("start_token"), F.col("end").alias("end_token"))


def report(packed: DataFrame, context_windows: DataFrame) -> DataFrame:
    """(window_name, capacity_tokens, n_windows, n_pieces, tokens, fill_rate) of packed windows."""
    size = F.col("end_token") - F.col("start_token")
    per = packed.groupBy("window_name", "window_id").agg(F.sum(size).alias("t"), F.count("*").alias("n"))
    per = per.groupBy("window_name").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_pieces"), F.sum("t").alias("tokens"))
    joined = per.join(F.broadcast(context_windows.select("window_name", "capacity_tokens").distinct()), "window_name")
    return joined.select("window_name", "capacity_tokens", "n_windows", "n_pieces", "tokens", F.round(F.col("tokens") / (F.col("n_windows") * F.col("capacity_tokens")), 6).alias("fill_rate"))


def shares(packed: DataFrame, source_mix: DataFrame) -> DataFrame:
    """(window_name, source, target_share, actual_share, mean_deviation, largest_deviation) of packed windows.

    Deviations are those of a source's share of the tokens in a window from its target, over all windows of the name.
    """
    size = F.sum(F.col("end_token") - F.col("start_token"))
    per = packed.groupBy("window_name", "window_id", "source").agg(size.alias("t"))
    whole = packed.groupBy("window_name", "window_id").agg(size.alias("w"))
    number = whole.groupBy("window_name").agg(F.count("*").alias("n"), F.sum("w").alias("all"))
    target = source_mix.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share")).distinct()
    held = per.join(whole, ["window_name", "window_id"]).join(F.broadcast(target), "source", "left").fillna(0.0, ["target_share"])
    away = F.abs(F.col("t") / F.col("w") - F.col("target_share"))
    sums = held.groupBy("window_name", "source").agg(F.sum("t").alias("t"), F.count("*").alias("k"), F.sum(away).alias("away"), F.max(away).alias("most"))
    every = number.join(F.broadcast(target)).unionByName(number.join(sums.select("window_name", "source").join(target, "source", "left_anti").distinct(), "window_name").withColumn("target_share", F.lit(0.0)).select("window_name", "n", "all", "source", "target_share"))
    both = every.alias("a").join(sums.alias("b"), (F.col("a.window_name") == F.col("b.window_name")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    absent = F.col("a.n") - F.coalesce("b.k", F.lit(0))
    mean = (F.coalesce("b.away", F.lit(0.0)) + absent * F.col("a.target_share")) / F.col("a.n")
    most = F.greatest(F.coalesce("b.most", F.lit(0.0)), F.when(absent > 0, F.col("a.target_share")).otherwise(0.0))
    return both.select("a.window_name", "a.source", "a.target_share", F.round(F.coalesce("b.t", F.lit(0)) / F.col("a.all"), 6).alias("actual_share"), F.round(mean, 6).alias("mean_deviation"), F.round(most, 6).alias("largest_deviation"))
