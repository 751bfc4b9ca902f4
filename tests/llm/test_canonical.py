"""Canonical forms against normalizing the whole text, and pairs against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import canonical as C

POOL = "aeió̧̈Aаео​­﻿  　 \t\n\r Ａ１ｶﾞﬁ①²Å각가一\U0001f600\U0001d400\U0002f800ıß-‐‑"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet=POOL, max_size=30), st.text(max_size=30)))
def test_segments_give_the_whole_form(text):
    segment = C._tables()[1]
    assert segment.sub(lambda m: C._normal(m[0]), text) == C._normal(text)
    got = C.canonical_text(text)
    assert C.canonical_text(got) == got
    key = C.comparison_key(text)
    assert C.comparison_key(key) == key and C.comparison_key(got) == key


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ａ１", "A1", True), ("café", "café", True), ("a​b﻿", "ab", True), ("a b", "a b", True), ("a　b\tc", "a b c", True), ("сор", "cop", True),
        ("a\r\nb\rc", "a\nb\nc", True), ("ﬁne", "fine", True), ("Å", "Å", True), ("a‑b", "a-b", True), ("ｶﾞ", "ガ", True), ("ё", "ë", True),
        ("①", "1", False), ("x²", "x2", False), ("naïve", "naive", False), ("A", "a", False), ("a  b", "a b", False), ("a\nb", "a b", False), ("straße", "strasse", False), ("ı", "i", False), ("l", "I", False), ("0", "O", False),
    ],
)
def test_cases(a, b, same):
    assert (C.comparison_key(a) == C.comparison_key(b)) is same


@pytest.mark.parametrize("text", ["Москва это хорошо", "мама мыла раму у окна", "\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\u2764\ufe0e", "Ελλάδα και Κύπρος", "\u0915\u094d\u200d\u0937", "naïve café", "\U0001d429 = 2"])
def test_right_text_stays(text):
    assert C.canonical_text(text) == text.replace("\ufe0e", "")


def test_words_of_mixed_script_come_to_one():
    assert C.canonical_text("p\u0430ypal и м\u0061ма") == "paypal и мама"
    assert C.comparison_key("\U0001d429aypal") == "paypal"
    assert C.comparison_key("\U0001f468\u200d\U0001f469") != C.comparison_key("\U0001f468\U0001f469")
    assert C.comparison_key("\u0645\u06cc\u200c\u062e") != C.comparison_key("\u0645\u06cc\u062e")
    assert C.comparison_key("a\u200cb\u200d c") == "ab c"


def test_table_of_look_alikes_from_a_file(tmp_path):
    (tmp_path / "confusables.txt").write_text("\ufeff# list\n0430 ;\t0061 ;\tMA\t# a\n13AA ;\t0047 ;\tMA\n0031 ; 006C ; MA\n00E6 ; 0061 0065 ; MA\n", encoding="utf-8")
    table = C.load_confusables(str(tmp_path / "confusables.txt"))
    assert table == {"\u0430": "a", "\u13aa": "G"}
    assert C.comparison_key("\u13aao", tuple(table.items())) == "Go"


def test_many_copies_and_one_variant(spark, monkeypatch):
    monkeypatch.setattr(C, "CLASS_ROWS", 40)
    n = 5_000
    rows = spark.range(n).selectExpr("id as doc_id", "'same text' as text").unionByName(spark.createDataFrame([(n, "same\u00a0text"), (n + 1, "same\u2009text"), (n + 2, "other")], "doc_id long, text string"))
    pairs = C.same_looking(rows)
    assert pairs.count() == 2 * n + 1
    found = C.classes(rows)
    assert found.count() == n + 2 and [tuple(r) for r in found.select("class_id", "n_variants", "n_documents").distinct().collect()] == [(0, 3, n + 2)]


def test_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["alpha beta", "café 1", "x² 2", "", None, "same", "мама"]
    swaps = [lambda t: t, lambda t: t.replace(" ", " "), lambda t: t.replace("a", "а"), lambda t: t + "​", lambda t: t.replace("1", "１")]
    rows = [(i, t if t is None else rnd.choice(swaps)(t), 0) for i in range(60) for t in [rnd.choice(base)]] + [(100 + i, "same", 1) for i in range(50)]
    rows.append((7_000, "z" * 300_000 + "́", 0))
    rows.append((7_001, "​" + "z" * 299_999 + "ź", 0))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, stored int, form string")
    got = {tuple(r) for r in C.same_looking(df).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and b[1] and a[1] != b[1] and C.comparison_key(a[1]) == C.comparison_key(b[1])}
    assert got == want and (7_000, 7_001) in got
    assert C.same_looking(df.limit(0)).count() == 0
    rows = {r["doc_id"]: r for r in C.canonical_rows(df).collect()}
    assert len(rows) == df.count() and rows[7_000]["changed"]
