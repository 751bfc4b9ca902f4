"""One consistent form for texts that look the same but are stored in different characters, and a key to compare them by.

The canonical form is that of Unicode's composition, with a few more folds: full and half width to ordinary width, any
blank within a line to the space, any line end to the line feed, hyphens that look alike to one, letter ligatures to their
letters, and what shows nothing to nothing; joiners between emoji and between letters of scripts whose shapes they change
do show and stay. Look-alike letters are brought to one script only in words that mix scripts, so Russian or Greek text stays what it
is. Raised and encircled characters, case, accents and the number of blanks stay as they are.

The comparison key goes further and is never stored as text: it takes every look-alike letter and mathematical letter to
the Latin one. Texts read the same when their keys are equal.

Most characters cannot change and cannot combine with what stands before them: their quick check says so. Only segments
of other characters, with the one character before them as context, are normalized; the results are spliced into
the rest of the text, which is never touched.

Defined cases. A null text stays null and an empty one empty; neither is ever part of a pair. Equal stored texts are no
pair. Texts of any length are treated whole. Only the named columns are read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.runtime import cut, spread

# Letters of other scripts with the shape of a Latin letter. Another table, such as one of load_confusables, can be given instead.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ү": "y", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϳ": "j",
    # Armenian
    "օ": "o", "Օ": "O", "ս": "u", "Տ": "S", "Լ": "L", "հ": "h",
    # other Latin shapes
    "ɡ": "g", "ɑ": "a",
}
HYPHENS = "\u2010\u2011"


def load_confusables(path: str) -> dict[str, str]:
    """Letters with one Latin look-alike, from a file in the form of Unicode's confusables.txt: source ; target ; class # note."""
    out = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            parts = [x.strip() for x in line.partition("#")[0].split(";")]
            if len(parts) > 1 and " " not in parts[0] and " " not in parts[1] and parts[0] and parts[1]:
                a, b = chr(int(parts[0], 16)), chr(int(parts[1], 16))
                if a.isalpha() and b.isascii() and b.isalpha() and not a.isascii():
                    out[a] = b
    return out


#: Letters whose shape the joiners change: Arabic and its kin, the scripts of India and South-East Asia, Mongolian.
JOINING = "\u0600-\u08ff\u0900-\u0dff\u0e00-\u109f\u1780-\u18af\ua800-\uaaff\ufb50-\ufdcf\ufdf0-\ufdff\ufe70-\ufefc"
EMOJI = "\u2190-\u21ff\u2300-\u23ff\u2460-\u27bf\u2900-\u297f\u2b00-\u2bff\U0001f000-\U0001faff"
_JOINERS = re.compile(f"(?<=[{EMOJI}])\u200d(?=[{EMOJI}])|(?<=\ufe0f)\u200d(?=[{EMOJI}])|(?<=[{JOINING}])[\u200c\u200d](?=[{JOINING}])")
#: Places for joiners that stay; none of them is ever a character of a text.
_KEPT = {"\u200c": "\ufdd0", "\u200d": "\ufdd1"}
_RESTORED = {ord(v): k for k, v in _KEPT.items()}
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"
_LETTERS = re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[{MARKS}])*")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
MATHEMATICAL = range(0x1D400, 0x1D800)
#: Rows of a class of equal texts that one task may get when pairs are written out.
CLASS_ROWS = 100_000
#: Characters that end a line and are not the line feed; the pair of both is one line end.
LINE_ENDS = "\r\x0b\x0c\x85\u2028\u2029"


def _fold(ch: str) -> str:
    """What a single, fully decomposed character becomes."""
    if ch in HYPHENS:
        return "-"
    if ch in LINE_ENDS:
        return "\n"
    kind = unicodedata.category(ch)
    if ch == "\t" or kind == "Zs":
        return " "
    if ch == "\n":
        return ch
    if kind in ("Cf", "Cc") or "\ufe00" <= ch <= "\ufe0f" or ch in "\u034f\u180b\u180c\u180d":
        return ""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    ligature = tag == "<compat>" and "LIGATURE" in unicodedata.name(ch, "")
    if tag in ("<wide>", "<narrow>") or ligature:
        return "".join(_fold(x) for x in unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split())))
    return ch


@cache
def _tables() -> tuple[dict[int, str], re.Pattern]:
    """The fold of every decomposed character that has one, and the pattern of an unstable segment with its context."""
    fold: dict[int, str] = {}
    unstable: set[int] = set()
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4 or 0x20000 <= code < 0xE0000 or code >= 0xF0000:
            continue  # surrogates; ideographs and syllables that never change
        ch = chr(code)
        if (to := _fold(ch)) != ch:
            fold[code] = to
        parts = unicodedata.normalize("NFD", ch)
        if code > 0xFFFF:
            continue  # all of them count as unstable, which keeps the pattern's class small
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", "".join(_fold(x) for x in parts)) != ch:
            unstable.add(code)
        shape = unicodedata.decomposition(ch).split(" ")
        if len(shape) == 2 and not shape[0].startswith("<"):
            unstable.add(int(shape[1], 16))  # may combine with the character before it
    unstable |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xF900, 0xFB00)}
    runs: list[list[int]] = []
    for code in sorted(unstable):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    chars = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)
    return fold, re.compile(f"[\\s\\S]?(?:\r\n|[{chars}\\U00010000-\\U0010ffff])+")


def _normal(segment: str) -> str:
    fold, _ = _tables()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", segment.replace("\r\n", "\n")).translate(fold))


def _script(ch: str) -> str:
    return unicodedata.name(ch, "").partition(" ")[0]


@cache
def _alike(table: tuple) -> tuple[dict[int, str], dict[str, dict[int, str]], re.Pattern, re.Pattern]:
    """(folds to Latin, folds from Latin by script, letters that have one, segments that the comparison key changes)."""
    to = {ord(a): b for a, b in table}
    back: dict[str, dict[int, str]] = {}
    for a, b in table:
        back.setdefault(_script(a), {})[ord(b)] = a
    key = to | {c: unicodedata.normalize("NFKC", chr(c)) for c in MATHEMATICAL if unicodedata.decomposition(chr(c)).startswith("<font>")}
    changed = [c for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and not 0x3400 <= c < 0xD7A4 and any(ord(x) in key for x in unicodedata.normalize("NFD", chr(c)))]
    chars = "".join(f"\\u{c:04x}" for c in changed) + f"\\U{MATHEMATICAL[0]:08x}-\\U{MATHEMATICAL[-1]:08x}"
    return key, back, re.compile(f"[{chars}]"), re.compile(f"(?:[{chars}][{MARKS}]*)+")


def _one_script(word: str, to: dict[int, str], back: dict[str, dict[int, str]]) -> str:
    """A word of Latin and other letters in one script, if its look-alikes allow it: Latin, or else that of its other letters."""
    parts = unicodedata.normalize("NFD", word)
    letters = [c for c in parts if c.isalpha()]
    others = [c for c in letters if not _LATIN.match(c)]
    if all(ord(c) in to for c in others):
        return unicodedata.normalize("NFC", parts.translate(to))
    scripts = {_script(c) for c in others if ord(c) not in to}
    if len(scripts) == 1 and (table := back.get(scripts.pop())) and all(ord(c) in table for c in letters if _LATIN.match(c)):
        return unicodedata.normalize("NFC", parts.translate(table))
    return word


def canonical_text(text: str | None, look_alikes: tuple = tuple(LOOK_ALIKES.items())) -> str | None:
    """The form in which a text is to be stored."""
    if not text:
        return text
    _, segment = _tables()
    joined = "\u200c" in text or "\u200d" in text
    if joined:
        text = _JOINERS.sub(lambda m: _KEPT[m[0]], text)
    text = segment.sub(lambda m: _normal(m[0]), text)
    to, back, letters, _ = _alike(look_alikes)
    if letters.search(text):
        text = _LETTERS.sub(lambda m: _one_script(m[0], to, back) if letters.search(m[0]) and _LATIN.search(m[0]) else m[0], text)
    return text.translate(_RESTORED) if joined else text


def comparison_key(text: str | None, look_alikes: tuple = tuple(LOOK_ALIKES.items())) -> str | None:
    """What texts that read the same have in common."""
    form = canonical_text(text, look_alikes)
    if not form:
        return form
    to, _, _, segments = _alike(look_alikes)
    return segments.sub(lambda m: unicodedata.normalize("NFC", unicodedata.normalize("NFD", m[0]).translate(to)), form)


def _udf(form, look_alikes: dict[str, str] | None):
    table = tuple((LOOK_ALIKES if look_alikes is None else look_alikes).items())

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: form(x, table), na_action="ignore")

    return run


def _formed(text: Column, form, look_alikes: dict[str, str] | None) -> Column:
    """A form of a text column. Plain printable ASCII is its own form; it goes through the Python stage as null."""
    plain = ~text.rlike("[^\\n -~]")
    return F.when(text.isNull() | plain, text).otherwise(_udf(form, look_alikes)(F.when(~plain, text)))


def canonical(text: Column, look_alikes: dict[str, str] | None = None) -> Column:
    return _formed(text, canonical_text, look_alikes)


def compared(text: Column, look_alikes: dict[str, str] | None = None) -> Column:
    return _formed(text, comparison_key, look_alikes)


def canonical_rows(documents: DataFrame, key: str = "doc_id", text: str = "text", look_alikes: dict[str, str] | None = None) -> DataFrame:
    """(key, canonical, changed) for every document."""
    form = canonical(F.col(text), look_alikes)
    return spread(documents.select(key, text)).select(F.col(key), F.col(text).alias("stored"), form.alias("canonical")).select(key, "canonical", (F.col("canonical") != F.col("stored")).alias("changed"))


def _members(documents: DataFrame, key: str, text: str, look_alikes: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """(members(id, form, stored), classes(form, stored, n, first)) of the forms that several stored texts have.

    A class is the documents of one stored text; forms with a single class have no pairs and leave here, so plain copies cost nothing.
    """
    live = spread(documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("id"), F.col(text).alias("text")))
    marked = live.select("id", F.sha2("text", 256).alias("stored"), compared(F.col("text"), look_alikes).alias("form")).select("id", F.unhex("stored").alias("stored"), F.unhex(F.sha2("form", 256)).alias("form"))
    marked = cut(marked)  # read twice below; the forms are not made twice
    classes = marked.groupBy("form", "stored").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    several = cut(classes.groupBy("form").agg(F.count("*").alias("n_variants"), F.sum("n").alias("n_documents"), F.min("first").alias("class_id")).where("n_variants > 1"))
    classes = cut(classes.join(several, "form"))
    return marked.join(classes.select("form", "stored", "n"), ["form", "stored"]).select("id", "form", "stored", "n"), classes


def same_looking(documents: DataFrame, key: str = "doc_id", text: str = "text", look_alikes: dict[str, str] | None = None) -> DataFrame:
    """(<key>_a, <key>_b), a < b: each pair of documents with equal comparison keys but different stored text.

    Classes of equal stored texts are paired, never documents; the members of a pair of classes are written out last, in
    parts of CLASS_ROWS, so a class of any size is no single task's.
    """
    members, classes = _members(documents, key, text, look_alikes)
    salts = lambda n: F.ceil(n / CLASS_ROWS).cast("int")
    salted = members.select("form", "stored", "id", F.pmod(F.xxhash64("id"), salts(F.col("n"))).cast("int").alias("salt")).distinct()
    side = lambda x: classes.select("form", F.col("stored").alias(f"stored_{x}"), F.explode(F.sequence(F.lit(0), salts(F.col("n")) - 1)).alias(f"salt_{x}"))
    parts = side("a").join(side("b"), "form").where("stored_a < stored_b")
    of = lambda x: salted.select("form", F.col("stored").alias(f"stored_{x}"), F.col("salt").alias(f"salt_{x}"), F.col("id").alias(f"id_{x}"))
    pairs = parts.join(of("a"), ["form", "stored_a", "salt_a"]).join(of("b"), ["form", "stored_b", "salt_b"]).where("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias(f"{key}_a"), F.greatest("id_a", "id_b").alias(f"{key}_b")).distinct()


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text", look_alikes: dict[str, str] | None = None) -> DataFrame:
    """(<key>, class_id, variant_id, n_variants, n_documents): one row per document that reads like one stored differently; ids are the least documents."""
    members, found = _members(documents, key, text, look_alikes)
    named = found.select("form", "stored", "class_id", F.col("first").alias("variant_id"), "n_variants", "n_documents")
    return members.select("form", "stored", F.col("id").alias(key)).join(named, ["form", "stored"]).select(key, "class_id", "variant_id", "n_variants", "n_documents")
