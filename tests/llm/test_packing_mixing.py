"""Token counts, windows and mixes."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import mixing, packing, tokens

DOCS = "doc_id long, text string, source string, tokens string, start long"
MIX = "source string, target_share double, max_repeats int"


def documents(seed, n, extra=()):
    rnd = random.Random(seed)
    words = "river table window garden copper signal harvest lantern".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(int(rnd.paretovariate(0.9) * 4))), rnd.choice(["a", "a", "a", "b", "c", None]), "x", 0) for i in range(n)]
    return rows + list(extra)


def test_counts():
    known = tokens.encoding()
    for text in ("", None, "a b", "naïve ①", "x" * 20_000, "a" + " " * 4_000 + "b"):
        assert tokens.count(text) == (len(known.encode_ordinary(text)) if text else 0)
    long = "a" + " " * 6_000 + "b" + "\n" * 7_000
    assert tokens.count(long) == len(known.encode_ordinary("a")) + len(known._encode_single_piece(" " * 5_999)) + len(known.encode_ordinary(" b")) + len(known._encode_single_piece("\n" * 7_000))


@pytest.mark.parametrize("shard_tokens", [packing.SHARD_TOKENS, 700])
def test_windows_hold_everything_once(spark, shard_tokens):
    rows = documents(3, 250, [(900, None, "a", "", 0), (901, "", "b", "", 0), (902, "river " * 3_000, "b", "", 0), (0, "again", "a", "", 0)])
    df = spark.createDataFrame(rows, DOCS)
    caps = spark.createDataFrame([("s", 64), ("l", 512)], "window_name string, capacity_tokens int")
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], MIX)
    out = packing.windows(df, caps, mix, shard_tokens=shard_tokens).collect()
    size = defaultdict(list)
    for d, text, *_ in rows:
        if text:
            size[d].append(tokens.count(text))
    for name, cap in (("s", 64), ("l", 512)):
        mine = [r for r in out if r["window_name"] == name]
        fill = Counter()
        for r in mine:
            fill[r["window_id"]] += r["end_token"] - r["start_token"]
        assert max(fill.values()) <= cap
        pieces = defaultdict(list)
        for r in mine:
            pieces[r["doc_id"]].append((r["start_token"], r["end_token"]))
        assert set(pieces) == set(size)
        for d, sizes in size.items():
            want = sorted((a, min(a + cap, n)) for n in sizes for a in range(0, n, cap))
            assert sorted(pieces[d]) == want
        total = sum(map(sum, size.values()))
        assert len(fill) <= 1.06 * -(-total // cap) + 1  # little room is left over


def test_windows_follow_the_mix():
    rnd = random.Random(2)
    sizes = [rnd.randrange(5, 40) for _ in range(4_000)]
    sources = ["a" if i % 2 else "b" for i in range(4_000)]
    windows = packing.pack(sizes, sources, 500, {"a": 0.25, "b": 0.75}, {})
    early = windows[: len(windows) // 2]
    share = sum(sizes[x] for w in early for x in w if sources[x] == "a") / sum(sizes[x] for w in early for x in w)
    assert abs(share - 0.25) < 0.01
    behind = packing.pack(sizes, sources, 500, {"a": 0.5, "b": 0.5}, {"a": 2_000.0, "b": -2_000.0})
    assert sum(sizes[x] for w in behind[:4] for x in w if sources[x] == "a") > 1_800  # a deficit from other shards is made good first


def test_no_documents_or_windows(spark):
    df = spark.createDataFrame(documents(1, 5), DOCS)
    caps = spark.createDataFrame([("s", 64)], "window_name string, capacity_tokens int")
    mix = spark.createDataFrame([], MIX)
    assert packing.windows(df.limit(0), caps, mix).count() == 0
    assert packing.windows(df, caps.limit(0), mix).count() == 0
    assert packing.windows(df, caps, mix).count() >= 5
    with pytest.raises(ValueError):
        packing.windows(df, spark.createDataFrame([("s", 0)], caps.schema), mix)


def brute_route(patterns, shares, repeats):
    """The greatest size by trying all subsets of sources."""
    names = [s for s in shares if any(s in p for p in patterns)]
    whole, best = sum(shares[s] for s in names), float("inf")
    for bits in range(1, 2 ** len(names)):
        some = {s for i, s in enumerate(names) if bits >> i & 1}
        cap = 0
        for p, n in patterns.items():
            own = [s for s in p if s in names]
            if some & set(own):
                cap += n * min(max(repeats[s] for s in own), sum(repeats[s] for s in own if s in some))
        best = min(best, cap * whole / sum(shares[s] for s in some))
    return best


def test_route_reaches_the_greatest_size():
    rnd = random.Random(4)
    for _ in range(25):
        names = ["a", "b", "c"]
        patterns = {p: rnd.randrange(50, 4_000) for p in [("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")] if rnd.random() < 0.7}
        shares = {s: rnd.choice([0.1, 0.3, 0.6]) for s in names}
        repeats = {s: rnd.randrange(1, 4) for s in names}
        if not patterns:
            continue
        got = mixing.route(patterns, shares, repeats)
        total = sum(got.values())
        assert abs(total - brute_route(patterns, shares, repeats)) <= 12
        for p, n in patterns.items():
            assert sum(f for (q, _), f in got.items() if q == p) <= n * max(repeats[s] for s in p)
            assert all(f <= n * repeats[s] for (q, s), f in got.items() if q == p)


def test_repetition_is_spread():
    got = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 100}, {"a": 0.5, "b": 0.5}, {"a": 4, "b": 4}, 300)
    use = Counter()
    for (p, _), f in got.items():
        use[p] += f
    assert max(use.values()) <= 100


@pytest.mark.parametrize("part_texts", [mixing.PART_TEXTS, 15])
def test_mix(spark, part_texts):
    rnd = random.Random(6)
    rows = [(i, f"text {rnd.randrange(260)} of the river table", rnd.choice(["a", "b", "c", "d", None]), "x", 0) for i in range(600)] + [(900, None, "a", "", 0), (901, "", "b", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    mix = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("e", 0.4, 1), (None, 0.1, 1)], MIX)
    out = mixing.mix(df, mix, part_texts=part_texts).collect()
    limit = {"a": 1, "b": 2, "c": 3}
    source = {r[0]: r[2] for r in rows}
    uses, by_source = Counter(), Counter()
    for r in out:
        assert source[r["doc_id"]] == r["source"] and r["use_no"] <= limit[r["source"]]
        uses[r["doc_id"]] += 1
        by_source[r["source"]] += r["tokens"]
    assert all(n <= limit[source[d]] for d, n in uses.items())
    total = sum(by_source.values())
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(by_source[s] / total - share) < 0.03
    shares = {r["source"]: r["actual_share"] for r in mixing.report(mixing.mix(df, mix), mix).collect()}
    assert shares["e"] == 0.0
    assert mixing.mix(df.limit(0), mix).count() == 0 and mixing.mix(df, mix.limit(0)).count() == 0
    again = mixing.mix(df, mix, part_texts=part_texts).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_every_document_of_a_text_is_used(spark):
    copies = [(i, "the same words in every copy", "a", "x", 0) for i in range(40)]
    others = [(100 + i, f"text {i} of the garden window", "b", "x", 0) for i in range(120)] + [(300, "the same words in every copy", "b", "x", 0)]
    df = spark.createDataFrame(copies + copies[:1] + others, DOCS)
    mix = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], MIX)
    out = mixing.mix(df, mix, part_texts=15).collect()
    uses, tokens_of = Counter(r["doc_id"] for r in out), Counter()
    for r in out:
        tokens_of[r["source"]] += r["tokens"]
    assert {d for d in uses if d < 100} == set(range(40))  # a text in 40 documents has 40 budgets
    assert all(uses[d] == 2 for d in range(40)) and max(uses.values()) <= 3
    assert len({(r["doc_id"], r["use_no"]) for r in out}) == len(out)
    supply = 40 * 2 * tokens.count("the same words in every copy")
    assert tokens_of["a"] == supply and abs(tokens_of["b"] - supply) < 0.03 * supply


def test_documents_of_one_text_do_not_share_a_budget():
    got = mixing.route({(("a", "b"), 0): 100, (("a",), 1): 100}, {"a": 2 / 3, "b": 1 / 3}, {"a": 2, "b": 2}, apart=True)
    assert sum(got.values()) == 600
    spread = mixing.route({(("a",), 0): 100, (("a",), 1): 100}, {"a": 1.0}, {"a": 4}, 100, apart=True)
    assert spread == {((("a",), 0), "a"): 100}  # texts come before their copies


def test_many_patterns_are_routed_in_bounded_time():
    rnd = random.Random(1)
    names = [f"s{i}" for i in range(16)]
    patterns = {}
    while len(patterns) < 20_000:
        patterns[tuple(sorted(rnd.sample(names, rnd.randrange(1, 7)))), rnd.randrange(4)] = rnd.randrange(1, 100_000)
    shares = {s: rnd.random() for s in names}
    repeats = {s: rnd.randrange(1, 5) for s in names}
    import time

    began = time.time()
    got = mixing.route(patterns, shares, repeats, apart=True)
    assert time.time() - began < 60
    sums = {s: sum(f for (_, x), f in got.items() if x == s) for s in names}
    whole = sum(sums.values())
    assert all(abs(sums[s] / whole - shares[s] / sum(shares.values())) < 1e-6 for s in names)
    assert all(f <= patterns[p] * repeats[s] for (p, s), f in got.items())


def test_small_patterns_are_taken_apart_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 12)
    rnd = random.Random(2)
    texts = [f"text number {i} of some words" for i in range(40)]
    rows = [(k * 100 + i, texts[i], s) for k, s in enumerate("abc") for i in range(40) if rnd.random() < 0.7]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 2), ("c", 0.25, 2)], "source string, target_share double, max_repeats int")).collect()
    whole = sum(r["tokens"] for r in got)
    for s, share in (("a", 0.5), ("b", 0.25), ("c", 0.25)):
        assert abs(sum(r["tokens"] for r in got if r["source"] == s) / whole - share) < 0.06
    assert max(r["use_no"] for r in got) <= 2
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows}


def test_long_documents_are_charged_to_their_source(spark):
    rows = [(i, "word " * 640, "long") for i in range(40)] + [(1_000 + i, "word " * 12, "long") for i in range(200)] + [(2_000 + i, "text " * 12, "short") for i in range(1_200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    caps = spark.createDataFrame([("w", 64)], "window_name string, capacity_tokens int")
    mix = spark.createDataFrame([("long", 0.5, 1), ("short", 0.5, 1)], "source string, target_share double, max_repeats int")
    packed = packing.windows(df, caps, mix, shard_tokens=100_000)
    first = {r["source"]: r["n"] for r in packed.where("window_id like '0-0-%' and cast(substring_index(window_id, '-', -1) as int) < 60").groupBy("source").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("n")).collect()}
    assert first.get("long", 0) < 0.1 * first["short"]  # its full windows have put it ahead
    again = packing.windows(df.repartition(3), caps, mix, shard_tokens=100_000)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, again.collect()))
    shares = {r["source"]: r for r in packing.shares(packed, mix).collect()}
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-5 and all(0 <= r["mean_deviation"] <= r["largest_deviation"] <= 1 for r in shares.values())


def test_routing_over_files_is_that_in_memory(spark, monkeypatch, tmp_path):
    """p7: beyond the bound nothing is taken apart, and the collection is the same."""
    rnd = random.Random(9)
    names = [f"s{i}" for i in range(7)]
    shares = {s: rnd.random() for s in names} | {"none": 0.5}
    repeats = {s: rnd.randrange(1, 4) for s in names} | {"none": 2}
    for total in (None, 60_000):
        patterns = {(tuple(sorted(rnd.sample(names, rnd.randrange(1, 5)))), rnd.randrange(3)): rnd.randrange(1, 3_000) for _ in range(150)}
        monkeypatch.setattr(mixing, "RANGE_CELLS", 23)
        keys = sorted(patterns)
        batches = [mixing.pa.RecordBatch.from_pylist([{"pattern": list(p), "grade": g, "tokens": patterns[p, g]} for p, g in part]) for part in (keys[:40], keys[40:])]
        folder = tmp_path / str(total)
        folder.mkdir()
        flow = mixing.FileRouting(str(folder), sorted(shares), repeats, iter(batches))
        flow.run(shares, total)
        got = {((tuple(r["pattern"]), r["grade"]), s): b - a for batch in flow.stretches() for r in batch.to_pylist() for s, a, b in zip(r["pattern"], r["first"], r["last"]) if b > a}
        assert got == mixing.route(patterns, shares, repeats, total, apart=True)
    rows = [(k * 100 + i, f"text number {i} of some words", s) for k, s in enumerate("abc") for i in range(40) if rnd.random() < 0.7]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 2), ("c", 0.25, 2)], MIX)
    whole = sorted(map(tuple, mixing.mix(df, mix).collect()))
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    assert sorted(map(tuple, mixing.mix(df, mix).collect())) == whole and whole
