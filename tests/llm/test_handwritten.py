"""Files nobody wrote by hand: held-out accuracy of the forest, notices, copies and odd inputs."""

import random

import pytest

from codeloom.llm import handwritten as H

SCHEMA = "file_id long, repo string, path string, language string, content binary, score double"
VERBS = ["load", "merge", "find", "build", "check", "write", "parse", "split", "store", "close"]
NOUNS = ["River", "Table", "Window", "Garden", "Copper", "Signal", "Harvest", "Lantern", "Meadow", "Anvil", "Basket", "Candle"]


def hand(rnd):
    out = ["# notes by the author", "import os", "", f"class {rnd.choice(NOUNS)}{rnd.choice(NOUNS)}:"]
    for verb in rnd.sample(VERBS, 4):
        out.append(f"    def {verb}{rnd.choice(NOUNS)}(self, value):")
        out += rnd.sample(["        # keep the order", "        total = value + 1", "        if value > 3:\n            return None", "        for item in value:\n            print(item)", "        raise ValueError('bad')"], 3)
        out.append("        return value")
    return "\n".join(out) + "\n"


def tool(rnd, notice):
    name = rnd.choice(NOUNS)
    out = [f"class {name}Stub:"]
    for i in range(rnd.randrange(4, 9)):
        out += [f"    def {rnd.choice(['get', 'set'])}Field{i:02}(self, value):", f"        return value + {rnd.randrange(99)}"]
    head = ["# Code generated by thing. DO NOT EDIT."] if notice else []
    return "\n".join(head + out) + "\n"


def data(rnd):
    return "TABLE = [\n" + "".join("  " + ", ".join(str(rnd.randrange(256)) for _ in range(16)) + ",\n" for _ in range(10)) + "]\n"


def test_held_out_files(spark):
    rnd = random.Random(7)
    rows, truth = [], {}
    for i in range(600):
        kind = rnd.choices(["hand", "marked", "bare", "data"], [0.7, 0.15, 0.1, 0.05])[0]
        text = {"hand": lambda: hand(rnd), "marked": lambda: tool(rnd, True), "bare": lambda: tool(rnd, False), "data": lambda: data(rnd)}[kind]()
        rows.append((i, "r", f"src/f{i}.py", "Python", text.encode(), 0.0))
        truth[i] = kind
    got = {r["file_id"] for r in H.not_handwritten(spark.createDataFrame(rows, SCHEMA)).collect()}
    bare = [i for i, k in truth.items() if k == "bare"]  # never labelled
    assert sum(i in got for i in bare) >= 0.9 * len(bare)
    own = [i for i, k in truth.items() if k == "hand"]
    assert sum(i in got for i in own) <= 0.03 * len(own)
    assert all(i in got for i, k in truth.items() if k in ("marked", "data"))


@pytest.mark.parametrize(
    ("comment", "label", "foreign"),
    [
        ("# Code generated by x. DO NOT EDIT.", 1, False), ("# Generiert von x. Nicht von Hand bearbeiten.", 1, False), ("# @generated by x", 1, False),
        ("# not generated: please edit", 0, False), ("# Written by hand; the generated twin lives elsewhere.", 0, False), ("# Parses x output, do not edit the wire format", 0, False),
        ("# This code generator writes the stubs. Edit it freely.", 0, False), ("# This file is part of libthing.", 0, True), ("# ! thing 1.2.3 | (c) 2020 thing contributors", 0, True),
        ("# Licensed under the terms in the LICENSE file of this repository.", 0, False), ("# Imported unchanged from thing 1.0; report problems upstream.", 0, True),
    ],
)
def test_notices(comment, label, foreign):
    found = H.measure(f"{comment}\nx = 'Code generated by y. DO NOT EDIT.'\n".encode(), "Python")
    assert found[1:3] == (label, foreign)


def test_notices_are_hidden_from_features():
    body = "\n".join(f"def getField{i}(a):\n    return a" for i in range(8))
    plain, marked = H.measure(body.encode(), "Python"), H.measure(("# Code generated by x. DO NOT EDIT.\n" + body).encode(), "Python")
    assert plain[0] == marked[0] and plain[3] == marked[3]


def test_copies_and_odd_inputs(spark):
    rnd = random.Random(1)
    code = hand(rnd)
    own = hand(random.Random(2))
    rows = [
        (1, "a", "vendor/lib/x.py", "Python", code.encode(), 0.0), (2, "b", "src/util/y.py", "Python", code.replace("# notes by the author", "# ours").replace("\n", "\r\n").encode(), 0.0),
        (3, "b", "src/vendor_portal/z.py", "Python", own.encode(), 0.0), (4, "c", "src/z.py", "Python", own.encode(), 0.0),
        (5, "c", "src/null.py", "Python", None, 0.0), (6, "c", "vendor/empty.py", "Python", b"", 0.0), (7, "c", "src/empty.py", "Python", b"", 0.0), (8, None, None, None, b"\xff\x00", 0.0),
        (9, "c", "src/long.py", "Python", b"x = 1\n" * 200_000, 0.0), (1, "a", "vendor/lib/x.py", "Python", code.encode(), 0.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(r["file_id"] for r in H.not_handwritten(df).collect())
    assert got == [1, 1, 2, 6]  # too few labels for a forest
    assert H.not_handwritten(df.limit(0)).count() == 0
    assert {r["repo"]: r["n_third_party"] for r in H.report(df).collect()}["a"] == 2
