"""Flat tables and dead references."""

import json
import random
from datetime import datetime, timedelta

import pytest

from codeloom.operators import flatten, orphans


def tree(depth, fan):
    def node(level, name):
        kids = [node(level + 1, f"{name}.{i}") for i in range(fan)] if level < depth else []
        return {"name": name, "zzz": [1, {"children": 3}], "id": name, "children": kids or None}

    return {"subsystems": [node(0, "a"), node(0, "b")], "meta": {}}


def walk(nodes, parent=""):
    for i, n in enumerate(nodes if isinstance(nodes, list) else []):
        if isinstance(n, dict):
            yield parent, i, n.get("id")
            yield from walk(n.get("children"), n.get("id"))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_any_depth(spark, levels):
    bodies = [json.dumps(tree(6, 1)), json.dumps(tree(2, 3), indent=1), '{"subsystems": []}', '{"subsystems": null}', '{"a": 1}', "[1]", "not json", '{"subsystems": [{"id": "x"}]', "{'subsystems': [{'id': 'q'}]}", None, "", '{"subsystems": [{"id": null, "children": [{"id": "k"}]}, null, {"id": "z", "children": []}]}', '{"subsystems": {"id": "x"}}', '"subsystems": [{"id": "x"}]}']
    rows = [(i, b, "extra") for i, b in enumerate(bodies)] + [(0, bodies[0], "again")]
    got = flatten.flatten_subsystems(spark.createDataFrame(rows, "record_id long, body string, parent_key string"), fields={}, levels=levels)
    want = set()
    for i, b in enumerate(bodies):
        try:
            data = json.loads(b)
        except (ValueError, TypeError):
            continue
        if isinstance(data, dict) and isinstance(data.get("subsystems"), list):
            want |= {(i, *x) for x in walk(data["subsystems"])}
    out = [(r["record_id"], r["parent_key"], r["pos"], r["child_key"]) for r in got.collect()]
    assert set(out) == want and len(out) == len(want)


@pytest.mark.parametrize("levels", [1, 4])
def test_an_odd_element_keeps_its_neighbours(spark, levels):
    odd = ["x", 5, 1.5, True, None, [], [{"id": "inner"}], "{\"id\": \"text\"}"]
    bodies = []
    for depth in range(6):
        for at in range(3):
            for value in odd:
                row = [{"id": "a", "interfaces": "no list", "children": 7}, {"id": "b"}]
                row.insert(at, value)
                for level in range(depth):
                    row = [{"id": f"p{level}", "name": value, "children": row}]
                bodies.append({"subsystems": row})
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9_000, '{"subsystems": [{"id": "a", "id": "b"}]}')]
    got = flatten.flatten_subsystems(spark.createDataFrame(rows, "record_id long, body string"), levels=levels)
    want = {(i, *x) for i, b in enumerate(bodies) for x in walk(b["subsystems"])}
    assert {(r["record_id"], r["parent_key"], r["pos"], r["child_key"]) for r in got.collect()} == want


def test_links_and_exports(spark):
    schema = "record_id long, impl_links array<struct<interface_name: string, implementor: string, impl_file: string, interface_file: string>>, exports_by_file map<string, array<struct<name: string, origin_file: string, via_file: string>>>"
    link = ("I", "C", "f", None)
    rows = [(1, [link, None, link], {"a": [("x", "o", None), None, ("y", None, None)], "b": None, "c": []}), (1, [link, None, link], None), (2, None, None), (3, [], {})]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r["pos"] for r in flatten.flatten_links(df).collect()) == [0, 2]
    assert sorted((r["parent_key"], r["pos"], r["child_key"]) for r in flatten.flatten_exports(df).collect()) == [("a", 0, "x"), ("a", 2, "y")]
    empty = spark.createDataFrame([], schema)
    assert flatten.flatten_links(empty).count() == 0 and flatten.flatten_exports(empty).count() == 0


T0 = datetime(2024, 1, 1)
REFS = "target string, manifest_id long, ref_value string, t timestamp, n int, source_key string"
SPANS = "target string, manifest_id long, ref_value string, since timestamp, until timestamp"


@pytest.mark.parametrize(("task_rows", "few"), [(1_000_000, True), (5, True), (5, False)])
def test_dead_against_brute_force(spark, task_rows, few, monkeypatch):
    from codeloom import runtime

    monkeypatch.setattr(runtime, "is_small", lambda df, rows=0: few)
    rnd = random.Random(3)
    day = lambda k: T0 + timedelta(days=k)
    spans = [("subsystem", rnd.randrange(3), f"k{rnd.randrange(6)}", day(a := rnd.randrange(50)), rnd.choice([None, day(a + rnd.randrange(30))])) for _ in range(40)]
    refs = [("subsystem", rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice(["k0"] * 5 + [f"k{j}" for j in range(8)]), rnd.choice([None, *map(day, range(60))]), 1, str(i)) for i in range(400)]
    gone = orphans.dead(spark.createDataFrame(refs, REFS), spark.createDataFrame(spans, SPANS), task_rows)
    alive = lambda r: any(s[:3] == r[:3] and r[3] is not None and s[3] <= r[3] and (s[4] is None or s[4] > r[3]) for s in spans)
    assert sorted(x["source_key"] for x in gone.collect()) == sorted(r[5] for r in refs if not alive(r))


def test_reference_cases(spark):
    subs = "manifest_id long, id string, domain string, dependencies array<string>, registered_at timestamp, deleted_at timestamp, synced_at timestamp, n int"
    rows = [(1, "a", "", ["b", None, "", "b"], T0, None, T0, 1), (1, "b", "d", None, T0 + timedelta(1), None, T0, 1), (1, "a", "", ["b", None, "", "b"], T0, None, T0, 1)]
    s = spark.createDataFrame(rows, subs)
    d = spark.createDataFrame([(1, "d", T0, T0)], "manifest_id long, domain_id string, registered_at timestamp, deleted_at timestamp")
    e = spark.createDataFrame([(7, 1, "b", T0), (8, 1, None, T0), (9, None, "b", T0)], "entity_id long, manifest_id long, subsystem_id string, scanned_at timestamp")
    got = {(r["ref_table"], r["ref_field"], r["source_key"], r["ref_value"]) for r in orphans.orphans(s, d, e).collect()}
    assert got == {("subsystems", "dependencies", "a", "b"), ("subsystems", "domain", "b", "d"), ("entity_summaries", "subsystem_id", "7", "b"), ("entity_summaries", "subsystem_id", "9", "b")}
    report = orphans.orphan_report(s, d, e).collect()
    assert sum(r["n_orphans"] for r in report) == 4 and sum(r["n_references"] for r in report) == 4
    assert orphans.orphans(s.limit(0), d, e.limit(0)).count() == 0
    assert orphans.orphans(s.limit(0), d.limit(0), e).count() == 2
