"""A collection in which each source has its target share of all tokens.

The same text may lie in several documents, each of which may be used as often as its source allows. The documents of a
text are ranked within their source in seeded order, and those of one rank form a set with one document per source at most.
The sets are aggregated by membership pattern, the sources that hold them and the grade of the rank, its power of two. A
min-cost flow on that small graph routes the tokens of the patterns to the quotas of the sources; using a text once more,
in the same document or another, costs more each time, so repetition is spread thin. The size of the collection is the
greatest for which all quotas can be met. Each pattern's sets then lie on a circle in seeded order, and each source takes
its flow as a stretch of the way around: a document is used as often as the stretch passes the middle of its set, which is
never more than allowed.

Defined cases. Null and empty texts and documents of sources outside the mix are not used. Rows that repeat a document
count once. Null or negative shares and repeats count as none. A source of the mix
without texts is left out and the other shares are scaled up; the report shows its share as 0. Empty tables give an empty
collection.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import tokens as T
from codeloom.runtime import broadcast_if_small, cut

#: Sources that a mix may have, as it is read into the driver.
MAX_SOURCES = 10_000
#: Cells of patterns times sources that the driver holds. More are routed just so by one task, over files of its own.
MAX_CELLS = 8_000_000
#: Cells that this task holds at once.
RANGE_CELLS = 1_000_000
#: Sets of documents that one part of a pattern's circle has on average.
PART_TEXTS = 20_000
#: The documents of one text are ranked in 2 ** COPY_BITS parts, as one text may be a large part of all documents.
COPY_BITS = 6
SEED = 11


class Routing:
    """Flow of least cost from patterns to sources, cost level by cost level: what a pattern gives never falls, as uses only get dearer.

    Paths go over sources alone: a source takes from a pattern that another gives up, and so on to a source that finds a pattern with
    room. What one step can carry is summed over all patterns at once, so there are few paths however many patterns there are.
    """

    def __init__(self, most: np.ndarray, need: np.ndarray) -> None:
        self.most, self.need = most, need.copy()  # most[p, s]: what source s may take of pattern p
        self.flow = np.zeros_like(most)
        self.room = np.zeros(len(most), np.int64)

    def _give(self, available: np.ndarray, amount: int) -> np.ndarray:
        return np.clip(amount - (np.cumsum(available) - available), 0, available)

    def _direct(self, s: int, amount: int) -> int:
        took = self._give(np.minimum(self.most[:, s] - self.flow[:, s], self.room), amount)
        self.flow[:, s] += took
        self.room -= took
        return int(took.sum())

    def open(self, room: np.ndarray) -> None:
        """Let patterns give that much more, and fill the sources as far as that goes."""
        self.room += room
        self.fill()

    def fill(self) -> None:
        for s in np.flatnonzero(self.need > 0):
            self.need[s] -= self._direct(s, int(self.need[s]))
        lost: set[int] = set()
        while len(left := [s for s in np.flatnonzero(self.need > 0) if s not in lost]):
            path, seen = self._path(int(left[0]))
            if path is None:
                lost |= seen  # whoever can be reached from there finds no room either
                continue
            amount = int(self.need[left[0]])
            for a, b in zip(path, path[1:]):
                amount = min(amount, self._carried(a, b))
            amount = self._direct(path[-1], amount)
            for a, b in reversed(list(zip(path, path[1:]))):
                self._move(a, b, amount)
            self.need[left[0]] -= amount

    def _carried(self, a: int, b: int) -> int:
        """What a could take of what b has."""
        return int(np.minimum(self.most[:, a] - self.flow[:, a], self.flow[:, b]).sum())

    def _move(self, a: int, b: int, amount: int) -> None:
        moved = self._give(np.minimum(self.most[:, a] - self.flow[:, a], self.flow[:, b]), amount)
        self.flow[:, a] += moved
        self.flow[:, b] -= moved

    def _finds_room(self, a: int) -> bool:
        return bool(np.minimum(self.most[:, a] - self.flow[:, a], self.room).any())

    def _givers(self, a: int) -> list[int]:
        """Sources that have something which a could take."""
        rows = np.flatnonzero(self.most[:, a] - self.flow[:, a])
        return [int(b) for b in np.flatnonzero((self.flow[rows] > 0).any(axis=0))]

    def _path(self, s: int) -> tuple[list[int] | None, set[int]]:
        by, queue = {s: -1}, deque([s])
        while queue:
            a = queue.popleft()
            if self._finds_room(a):
                path = []
                while a >= 0:
                    path.append(a)
                    a = by[a]
                return path[::-1], set(by)
            for b in self._givers(a):
                if b not in by:
                    by[b] = a
                    queue.append(b)
        return None, set(by)


class FileRouting(Routing):
    """The same flow over files in a folder: only cells of sources that hold a pattern, taken up one range of patterns at a time, within it by source."""

    def __init__(self, folder: str, names: list[str], repeats: dict[str, int], batches: Iterator[pa.RecordBatch]) -> None:
        """batches (pattern, grade, tokens), in order."""
        self.folder, self.names, self.repeats = folder, names, np.array([repeats[s] for s in names], np.int64)
        kinds = {"who": np.int32, "grade": np.int32, "amount": np.int64, "uses": np.int64, "size": np.int64}
        files = {k: open(f"{folder}/{k}", "wb") for k in kinds}
        held = np.zeros(len(names), np.int64)
        for batch in batches:
            lists = batch.column("pattern")
            who = pc.index_in(lists.flatten(), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int32)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(size):
                continue
            held += np.bincount(who, minlength=len(names))
            uses = np.add.reduceat(self.repeats[who], np.cumsum(size) - size)
            for k, v in (("who", who), ("size", size), ("uses", uses), ("grade", batch.column("grade").to_numpy()), ("amount", batch.column("tokens").to_numpy())):
                v.astype(kinds[k]).tofile(files[k])
        for f in files.values():
            f.close()
        self.who, self.grade, self.amount, self.uses, size = (np.asarray(np.memmap(f"{folder}/{k}", v, "r")) for k, v in kinds.items())
        self.room = np.asarray(np.memmap(f"{folder}/room", np.int64, "w+", shape=self.amount.shape))
        self.start = np.asarray(np.memmap(f"{folder}/start", np.int64, "w+", shape=len(size) + 1))  # where the cells of a pattern begin in who
        self.start[1:] = np.cumsum(size)
        step = max(1, RANGE_CELLS * len(size) // len(self.who))
        self.edges = np.array([*range(0, len(size), step), len(size)], np.int64)
        self.live = held > 0  # sources with texts
        self.rows, self.flow = (np.asarray(np.memmap(f"{folder}/{k}", np.int64, "w+", shape=self.who.shape)) for k in ("rows", "flow"))
        self.begin = np.empty((len(self.edges) - 1, len(names) + 1), np.int64)  # where the cells of a source in a range begin
        for r, (lo, hi) in enumerate(zip(self.edges, self.edges[1:])):
            i, j = self.start[lo], self.start[hi]
            who = self.who[i:j]
            self.rows[i:j] = np.repeat(np.arange(lo, hi), np.diff(self.start[lo : hi + 1]))[np.argsort(who, kind="stable")]
            self.begin[r] = i + np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(names)))])

    def _cells(self, r: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, flow, to be changed in place, and what is free, of a source in a range."""
        i, j = self.begin[r, s], self.begin[r, s + 1]
        rows, flow = self.rows[i:j], self.flow[i:j]
        return rows, flow, self.amount[rows] * self.repeats[s] - flow

    def _shared(self, r: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flow of a and b and what a could take of b's, for the patterns both hold in a range, with their places."""
        (ra, fa, free), (rb, fb, _) = self._cells(r, a), self._cells(r, b)
        _, ia, ib = np.intersect1d(ra, rb, assume_unique=True, return_indices=True)
        return fa, fb, ia, ib, np.minimum(free[ia], fb[ib])

    def _ranges(self) -> range:
        return range(len(self.edges) - 1)

    def _direct(self, s: int, amount: int) -> int:
        left = amount
        for r in self._ranges():
            if not left:
                break
            rows, flow, free = self._cells(r, s)
            took = self._give(np.minimum(free, self.room[rows]), left)
            flow += took
            self.room[rows] -= took
            left -= int(took.sum())
        return amount - left

    def _carried(self, a: int, b: int) -> int:
        return sum(int(self._shared(r, a, b)[4].sum()) for r in self._ranges())

    def _move(self, a: int, b: int, amount: int) -> None:
        for r in self._ranges():
            if not amount:
                break
            fa, fb, ia, ib, both = self._shared(r, a, b)
            moved = self._give(both, amount)
            fa[ia] += moved
            fb[ib] -= moved
            amount -= int(moved.sum())

    def _finds_room(self, a: int) -> bool:
        return any(np.minimum(free, self.room[rows]).any() for rows, _, free in (self._cells(r, a) for r in self._ranges()))

    def _givers(self, a: int) -> list[int]:
        found = np.zeros(len(self.names), bool)
        for r in self._ranges():
            lo, hi = self.edges[r], self.edges[r + 1]
            open_ = np.zeros(hi - lo, bool)
            rows, _, free = self._cells(r, a)
            open_[rows - lo] = free > 0
            i, j = self.start[lo], self.start[hi]
            given = np.concatenate([[0], np.cumsum((self.flow[i:j] > 0) & open_[self.rows[i:j] - lo])])
            found |= np.diff(given[self.begin[r] - i]) > 0
        return [int(b) for b in np.flatnonzero(found)]

    def run(self, shares: dict[str, float], total: int | None) -> None:
        share = np.array([shares[s] if self.live[k] else 0.0 for k, s in enumerate(self.names)])
        whole = sum(shares[s] for k, s in enumerate(self.names) if self.live[k])
        capacity, pairs, high = np.zeros(len(self.names), np.int64), set(), 0
        for r in self._ranges():
            lo, hi = self.edges[r], self.edges[r + 1]
            capacity += [int(self._cells(r, s)[2].sum()) for s in range(len(self.names))]
            high += int((self.amount[lo:hi] * self.uses[lo:hi]).sum())
            pairs |= set(zip((2 ** self.grade[lo:hi].astype(np.int64) - 1).tolist(), self.uses[lo:hi].tolist()))
        quotas = lambda size: np.array([int(size * x / whole) for x in share], np.int64)
        self.need = quotas(greatest(high if total is None else min(high, total), lambda size: bool((quotas(size) <= capacity).all())))
        for level in sorted({b + k for b, n in pairs for k in range(n)}):
            if not self.need.any():
                break
            for r in self._ranges():
                lo, hi = self.edges[r], self.edges[r + 1]
                before = 2 ** self.grade[lo:hi].astype(np.int64) - 1
                self.room[lo:hi] += np.where((before <= level) & (level < before + self.uses[lo:hi]), self.amount[lo:hi], 0)
            self.fill()

    def stretches(self) -> Iterator[pa.RecordBatch]:
        """(pattern, grade, around, first, last) of all patterns; first and last by source of the pattern."""
        for r in self._ranges():
            lo, hi = self.edges[r], self.edges[r + 1]
            cells = [self._cells(r, s)[:2] for s in range(len(self.names))]
            flow = np.concatenate([f for _, f in cells])[np.argsort(np.concatenate([x for x, _ in cells]), kind="stable")]
            ends = (self.start[lo : hi + 1] - self.start[lo]).astype(np.int32)
            summed = np.concatenate([[0], np.cumsum(flow)])
            base = np.repeat(summed[ends[:-1]], np.diff(ends))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(self.names, pa.string()).take(pa.array(self.who[self.start[lo] : self.start[hi]])), pa.array(summed[:-1] - base), pa.array(summed[1:] - base))]
            yield pa.RecordBatch.from_arrays([lists[0], pa.array(self.grade[lo:hi]), pa.array(self.amount[lo:hi]), *lists[1:]], names=["pattern", "grade", "around", "first", "last"])


def greatest(high: int, fits: Callable[[int], bool]) -> int:
    """The greatest size up to high that fits."""
    low = 0
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low


def route(patterns: dict[tuple, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None, apart: bool = False) -> dict[tuple[tuple, str], int]:
    """(pattern, source) -> tokens, for the greatest collection that meets all shares, or one of about total tokens if that is less.

    A pattern is the sources that hold a text as one document. With apart it is (sources, grade): each source holds a document of
    its own, which it may use as often as it allows whatever the others do, and the text has 2 ** grade - 1 other documents before.
    """
    held = {p: p[0] if apart else p for p in patterns}
    names = sorted(s for s in shares if shares[s] > 0 and repeats.get(s, 0) > 0 and any(s in held[p] for p in patterns))
    whole = sum(shares[s] for s in names)
    live = {p: n for p, n in patterns.items() if n > 0 and any(s in names for s in held[p])}
    if not names or not live:
        return {}
    keys = sorted(live)
    uses = np.array([(sum if apart else max)(repeats[s] for s in held[p] if s in names) for p in keys], np.int64)
    amount = np.array([live[p] for p in keys], np.int64)
    column = {s: j for j, s in enumerate(names)}
    most = np.zeros((len(keys), len(names)), np.int64)
    for i, p in enumerate(keys):
        for s in held[p]:
            if s in column:
                most[i, column[s]] = live[p] * repeats[s]
    before = np.array([2 ** p[1] - 1 if apart else 0 for p in keys], np.int64)
    quotas = lambda size: np.array([int(size * shares[s] / whole) for s in names], np.int64)

    def fits(size: int) -> bool:
        if apart:  # sources take nothing from each other
            return bool((quotas(size) <= most.sum(axis=0)).all())
        whole_way = Routing(most, quotas(size))
        whole_way.open(amount * uses)
        return not whole_way.need.any()

    high = int((amount * uses).sum())
    best = Routing(most, quotas(greatest(high if total is None else min(high, total), fits)))  # the greatest size whose quotas can be met
    levels = sorted({int(b) + k for b, n in set(zip(before.tolist(), uses.tolist())) for k in range(n)})
    for level in levels:  # a text's use number level costs its square, so the levels come in the order of their costs
        if not best.need.any():
            break
        best.open(np.where((before <= level) & (level < before + uses), amount, 0))
    return {(keys[i], names[j]): int(best.flow[i, j]) for i, j in zip(*np.nonzero(best.flow))}


def ranked(documents: DataFrame, seed: int) -> DataFrame:
    """documents (digest, source, doc_id, tokens) with rank, from 0, among those of the same text and source in seeded order."""
    of = F.xxhash64("doc_id", F.lit(seed))
    parted = documents.withColumn("of", of).withColumn("slice", F.shiftrightunsigned("of", 64 - COPY_BITS))
    earlier = Window.partitionBy("digest", "source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("digest", "source", "slice").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inner = Window.partitionBy("digest", "source", "slice").orderBy("of", "doc_id")
    return parted.withColumn("nth", F.row_number().over(inner) - 1).join(base, ["digest", "source", "slice"]).select("digest", "source", "doc_id", "tokens", (F.col("base") + F.col("nth")).alias("rank"))


def _routed_by_task(sums: DataFrame, shares: dict[str, float], repeats: dict[str, int], total: int | None) -> DataFrame:
    """What route gives, as stretches, made by one task in files of its own, so that no memory has to hold all patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            batches = (b for b in batches if b.num_rows)
            first = next(batches, None)
            if first is not None:
                flow = FileRouting(folder, sorted(shares), repeats, chain([first], batches))
                flow.run(shares, total)
                yield from flow.stretches()

    ordered = sums.select("pattern", "grade", "tokens").repartition(1).sortWithinPartitions("pattern", "grade")
    found = ordered.mapInArrow(run, "pattern array<string>, grade int, around long, first array<long>, last array<long>")
    each = found.withColumn("source", F.col("pattern")).select("pattern", "grade", "around", F.inline(F.arrays_zip("source", "first", "last")))
    return cut(each.where("last > first").select("pattern", "grade", "source", "first", "last", "around"))


def mix(documents: DataFrame, source_mix: DataFrame, vocabulary: str = T.VOCABULARY, total_tokens: int | None = None, seed: int = SEED, part_texts: int = PART_TEXTS) -> DataFrame:
    """(source, doc_id, use_no, tokens): the documents of the collection, one row for each use."""
    wanted = source_mix.where("source is not null and target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = {r["source"]: float(r["target_share"]) for r in wanted}
    repeats = {r["source"]: int(r["max_repeats"]) for r in wanted}
    inside = documents.where(F.col("source").isin(list(shares) or [""]) & (F.length("text") > 0))
    held = cut(T.sizes(inside, vocabulary).groupBy("digest", "source", "doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0"))
    texts = ranked(held, seed).groupBy("digest", "rank").agg(F.max("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("where"))  # one entry per source
    texts = texts.withColumn("pattern", F.expr("transform(where, x -> x.source)")).withColumn("grade", F.length(F.bin(F.col("rank") + 1)) - 1).withColumn("at", F.xxhash64("digest", "rank", F.lit(seed)))
    texts = cut(texts)
    sums = texts.groupBy("pattern", "grade").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    bound = max(1, MAX_CELLS // max(1, len(shares)))
    known = sums.limit(bound + 1).collect()
    if len(known) > bound:
        sums = cut(sums)
        most = sums.agg(F.max("n")).first()[0]
        stretches = _routed_by_task(sums, shares, repeats, total_tokens)
    else:
        most = max([r["n"] for r in known], default=0)
        length = {(tuple(r["pattern"]), r["grade"]): int(r["tokens"]) for r in known}
        flows = route(length, shares, repeats, total_tokens, apart=True)
        rows = []
        for p in sorted(length):
            at = 0
            for s in p[0]:
                if flow := flows.get((p, s)):
                    rows.append((list(p[0]), p[1], s, at, at + flow, length[p]))
                    at += flow
        stretches = documents.sparkSession.createDataFrame(rows, "pattern array<string>, grade int, source string, first long, last long, around long")
    # seeded order and running sums: parts of the hash range, sums per part, then within each part
    bits = max(0, (most // part_texts).bit_length())
    part = F.shiftrightunsigned("at", 64 - bits) if bits else F.lit(0).cast("long")
    parted = texts.withColumn("part", part)
    per_part = parted.groupBy("pattern", "grade", "part").agg(F.sum("tokens").alias("t"))
    base = per_part.withColumn("base", F.coalesce(F.sum("t").over(Window.partitionBy("pattern", "grade").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inner = Window.partitionBy("pattern", "grade", "part").orderBy("at", "digest", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.withColumn("run", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(base, ["pattern", "grade", "part"]).withColumn("start", F.col("base") + F.col("run"))
    met = placed.withColumn("start", F.col("start") + F.expr("tokens div 2")).join(broadcast_if_small(stretches), ["pattern", "grade"])  # by its middle
    # laps k with first <= start + k * around < last
    lap0, lap1 = F.ceil((F.col("first") - F.col("start")) / F.col("around")), F.ceil((F.col("last") - F.col("start")) / F.col("around")) - 1
    used = met.withColumn("lap0", lap0.cast("long")).withColumn("lap1", lap1.cast("long")).where("lap1 >= lap0").withColumn("use_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("lap1") - F.col("lap0") + 1)))
    doc = F.expr("filter(where, x -> x.source = source)[0].doc_id")
    return used.select("source", doc.alias("doc_id"), "use_no", "tokens")


def report(mixed: DataFrame, source_mix: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_documents, tokens, most_uses) of a collection."""
    per = mixed.groupBy("source").agg(F.countDistinct("doc_id").alias("n_documents"), F.sum("tokens").alias("tokens"), F.max("use_no").alias("most_uses"))
    whole = mixed.agg(F.sum("tokens").alias("whole"))
    joined = source_mix.select("source", "target_share").join(F.broadcast(per), "source", "left").join(F.broadcast(whole))
    share = F.coalesce(F.round(F.col("tokens") / F.col("whole"), 6), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("source", "target_share", share.alias("actual_share"), zero("n_documents"), zero("tokens"), zero("most_uses"))
