"""Generated, minified, vendored and data files among source files, so that hand-written source remains.

A random forest learns from files whose notices say what they are, and judges all others by features from which the
notices are hidden: compression ratio, token entropy, identifier lengths, comment density and the regularity of lines and
names, all taken from the text without comments, and marks in the path. Data blobs carry no notices; for the training only, a file whose
tokens or characters are literals almost throughout is labelled as one, a share that is no feature. Third-party code looks like any
other code, so it is no matter for the forest: its notices and its folders tell it, and every copy of the same code, however
commented and laid out, counts with it wherever it lies. A notice decides for its own file.

Defined cases. Null content is no case and has zero features. Empty files and files without code are hand-written
unless a notice or a folder says otherwise, and pass nothing on to copies. Content that is not UTF-8 is read with
replacement characters. Repeated rows are judged each for itself. With too few labelled files for a forest, notices, folders
and copies decide alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import syntax
from codeloom.runtime import cut, lookup, partitions, spread

#: Files the forest is trained on at most; the sample is by hash, so it is the same in every run.
TRAIN_FILES = 30_000
#: Score from which a file without notice is no hand-written one. Only a part of such files carry notices, so the score of their kind stays far below one.
THRESHOLD = 0.2
TREES, DEPTH, SEED = 24, 7, 17
#: Code of fewer characters is too little to say where a copy comes from.
COPY_CHARS = 60
#: Labelled files of either kind below which no forest is trained.
LEAST_LABELS = 20

# Public conventions of notices, not values of any one project: who generated a file or that its changes get lost (the header
# of Go tools, the marks of .NET and of Meta's tools, and their wordings in a few languages), source maps of bundlers, and the
# notices of licences and package managers. Denials and mentions of generators in other comments do not match.
_NO = r"(?<!\bnot )(?<!\bn't )(?<!\bnever )"
GENERATED = re.compile(
    rf"(?im){_NO}\b(?:code|file|source|(?:this file|it) (?:was|is)|automatically|auto|machine)[- ]?generated[- ](?:by|from|with|using|file|code)\b|<auto-?generated\b|(?<!\S)@generated\b|\bdo not (?:edit|modify|change)(?: (?:this file|it|by hand|manually|directly))*\W*$"
    r"|\b(?:edits?|changes?|modifications?) (?:to this file |made here )?(?:will be|is|are|may be|get|gets) (?:lost|overwritten|overridden|discarded)\b|\b(?:please )?re-?generate (?:it |this file )?(?:with|by|using)\b|\bmachine[- ](?:made|written)\b"
    r"|\b(?:generiert|erzeugt) (?:von|durch|aus|mit)\b|\bnicht (?:von hand |manuell )(?:bearbeiten|ändern)\b|\bgénéré (?:automatiquement )?par\b|\bne pas modifier\W*$|\bgenerado (?:automáticamente )?por\b|\bno (?:editar|modificar)\W*$"
)
#: Parts, in lower case, of which every match of GENERATED has one.
_GENERATED_PARTS = ("generat", "generi", "génér", "edit", "modif", "change", "machine", "erzeugt", "bearbeiten", "ändern")
MINIFIED = re.compile(r"[#@] sourceMappingURL=")
THIRD_PARTY = re.compile(
    r"(?im)^\W*this file is part of \S+\.?\s*$|\bis free software[:;] you can redistribute it\b|^\W*!?\s*\S+ v?\d+\.\d[\w.+-]* \| \(c\) |^\W*copyright (?:\(c\)|©) \d{4}(?:[-, ]+\d{4})* (?:the )?\S+ (?:authors|contributors|developers|project|foundation)\b|\bSPDX-FileCopyrightText:"
    r"|^\W*(?:origin|upstream|vendored from|copied from|taken from)\W+\S+@v?\d|^\W*(?:imported|vendored|copied|taken) (?:unchanged|verbatim|unmodified) from\b|^\W*@license\b"
)
# Names of folders that hold third-party code.
FOLDERS = r"(?i)(^|/)(vendor|vendored|_vendor|node_modules|bower_components|third_party|third-party|thirdparty|3rdparty|3rd_party|deps|external|extern|pods|carthage)/"

# Parts of file names and folders that tools like to use. They are features among others and decide nothing alone.
NAME_MARK = re.compile(r"(?i)\.(?:gen|generated|pb|g|designer|min|bundle)\.|_pb2?(?:_grpc)?\.|^zz_generated\b|^moc_|[a-z]grpc\.|\.[0-9a-f]{8}\.")
FOLDER_MARK = re.compile(r"(?i)(?:^|/)(?:generated|__generated__|autogen|src_managed)/")

_TOKEN = re.compile(r'""|[^\W\d]\w*|\d[\w.]*|[^\s\w]')
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_MEMBER = re.compile(r"(?<![^\W\d])([^\W\d]\w*+)\s*+\(")
_HEAD = re.compile(r"_*[A-Z]?[a-z]+(?=[A-Z_\d])")
_DIGIT = re.compile(r"\d")
_NAME_RUN = re.compile(r"[^\W\d]\w*")
_NUMBER_RUN = re.compile(r"\d[\w.]*")
FEATURES = (
    "compression", "token_entropy", "name_length", "short_names", "distinct_names", "comment_density", "longest_line", "mean_line",
    "digits", "line_shapes", "first_word_entropy", "numbered_names", "lines", "calls", "branches", "name_grid", "numbered_members", "members", "name_mark", "folder_mark", "longest_literal",
)


def split(text: str, language: str | None) -> tuple[str, str, str, int]:
    """(code, code with its literals, comments, length of the longest literal): code has literals as empty strings. Never fails: what does not end stays code."""
    if language not in syntax.LEXERS:
        return text, text, "", 0
    code: list[str] = []
    whole: list[str] = []
    comments: list[str] = []
    at = longest = 0
    for start, end, kind in syntax.lexemes(text, language):
        if kind not in ("k", "s"):
            continue
        before, found = text[at:start], text[start:end]
        at = end
        if kind == "k":
            comments.append(found)
            code += (before, "\n" if "\n" in found else " ")
            whole.append(before)
        else:
            code += (before, '""')
            whole += (before, found)
            longest = max(longest, len(found))
    code.append(text[at:])
    whole.append(text[at:])
    return "".join(code), "".join(whole), "\n".join(comments), longest


def _entropy(counts: Counter) -> float:
    total = sum(counts.values())
    return -sum(n / total * math.log2(n / total) for n in counts.values()) if total else 0.0


def measure(content: bytes | None, language: str | None, path: str | None = None) -> tuple[list[float], int, bool, bytes | None]:
    """(features, label, third-party notice, code digest); label 0 none, 1 generated, 2 minified, 3 data."""
    if content is None:
        return [0.0] * len(FEATURES), 0, False, None
    text = content.decode("utf-8", "replace").lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")
    code, whole, comments, longest = split(text, language)
    label, foreign, shown = 0, False, comments
    if comments:
        low = comments.lower()
        label = 1 if any(map(low.__contains__, _GENERATED_PARTS)) and GENERATED.search(comments) else 2 if MINIFIED.search(comments) else 0
        foreign = bool(THIRD_PARTY.search(comments))
        if label or foreign:
            shown = "".join(x for x in comments.split("\n") if not any(p.search(x) for p in (GENERATED, MINIFIED, THIRD_PARTY)))
    dense = "".join(code.split())
    tokens = Counter(_TOKEN.findall(code))
    names = {x: k for x, k in tokens.items() if x[0].isalpha() or x[0] == "_"}
    literals = sum(k for x, k in tokens.items() if x == '""' or x[0].isdigit())
    words = sum(names.values())
    blob = literals >= 20 and literals > 0.9 * (literals + words)
    if not label and (blob or len(whole) - len(code) > max(200, 0.9 * len(whole))):
        label = 3
    lines = [x for x in map(str.strip, _NUMBER_RUN.sub("0", _NAME_RUN.sub("w", code)).split("\n")) if x]
    stripped = [x for x in map(str.strip, code.split("\n")) if x]
    lengths = list(map(len, stripped))
    firsts = Counter(m[0].lower() for x in names if len(x) > 3 and (m := _WORDS.search(x)) and m.end() < len(x))
    members = [(x, m.end()) for x in set(_MEMBER.findall(code)) if (m := _HEAD.match(x))]
    grid = len({x[:k].lower() for x, k in members}) + len({x[k:].strip("_").lower() for x, k in members})
    n, many = max(1, words), max(1, len(names))
    raw = "\n".join(stripped).encode()
    features = [
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        _entropy(tokens),
        sum(len(x) * k for x, k in names.items()) / n,
        sum(k for x, k in names.items() if len(x) <= 2) / n,
        many / n,
        len(shown) / max(1, len(shown) + len(dense)),
        math.log1p(max(lengths, default=0)),
        math.log1p(len(dense) / max(1, len(lines))),
        sum(map(dense.count, "0123456789")) / max(1, len(dense)),
        len(set(lines)) / max(1, len(lines)),
        _entropy(firsts),
        sum(1 for x in names if _DIGIT.search(x)) / many,
        math.log1p(len(lines)),
        code.count("(") / n,
        sum(names.get(x, 0) for x in ("if", "for", "while", "foreach", "switch", "match", "each", "throw", "raise")) / max(1, len(lines)),
        grid / (2 * len(members)) if members else 1.0,  # names that combine few heads with few tails
        sum(1 for x, _ in members if _DIGIT.search(x)) / max(1, len(members)),
        float(len(members)),
        float(bool(NAME_MARK.search((path or "").rpartition("/")[2]))),
        float(bool(FOLDER_MARK.search(path or ""))),
        math.log1p(longest),
    ]
    kept = "".join(whole.split()) if len(dense) >= COPY_CHARS else ""
    return features, label, foreign, hashlib.blake2b(kept.encode(), digest_size=16).digest() if kept else None


_SCHEMA = "file_id long, repo string, path string, label int, notice boolean, code binary, features array<double>"


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [measure(c, x, p) for c, x, p in zip(pdf["content"], pdf["language"], pdf["path"])]
        out = pdf[["file_id", "repo", "path"]].copy()
        out["label"], out["notice"], out["code"], out["features"] = [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[0] for r in rows]
        yield out


def measured(files: DataFrame) -> DataFrame:
    """file_id, repo, path, label, notice, code, features and folder of each file, written to the shared folder."""
    rows = spread(files.select("file_id", "repo", "path", "language", "content")).mapInPandas(_measured, _SCHEMA)
    return cut(rows.withColumn("folder", F.coalesce(F.col("path").rlike(FOLDERS), F.lit(False))))


def _forest(rows: DataFrame, train_files: int):
    """The forest, or None with too few labels; trained on a sample by hash of at most about train_files files."""
    usable = rows.where("not notice and not folder")
    total, known = usable.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    if known < LEAST_LABELS or total - known < LEAST_LABELS:
        return None
    share = min(1.0, train_files / total)
    sample = usable.where(F.pmod(F.xxhash64("file_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else usable
    data = sample.select(array_to_vector("features").alias("features"), (F.col("label") > 0).cast("double").alias("label"))
    data = cut(data.coalesce(max(1, min(partitions(rows.sparkSession), 8))))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, maxBins=48, maxMemoryInMB=64).fit(data)


def _scored(rows: DataFrame, model) -> DataFrame:
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).drop("features")
    vector = rows.withColumn("vector", array_to_vector("features")).drop("features").withColumnRenamed("vector", "features")
    return model.transform(vector).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _decided(scored: DataFrame, threshold: float) -> DataFrame:
    """scored with sort and decided_by: the file's own notice, its folder, a copy of its code elsewhere, or the forest."""
    marked = F.col("label").isin(1, 2)
    by = F.when(F.col("notice"), "notice").when(F.col("folder"), "folder").when(F.col("copied"), "copy").when(marked, "notice").when(F.col("score") >= threshold, "forest")
    sort = F.when(F.col("notice") | F.col("folder") | F.col("copied"), "third_party").when(marked | (F.col("score") >= threshold), "tool")
    return scored.withColumn("sort", sort).withColumn("decided_by", by)


def _with_copies(rows: DataFrame) -> DataFrame:
    """rows with copied: whether code equal to a file's lies in a file with a third-party notice or folder.

    Digests are looked up, not files: a file without one never takes part, and one that a large part of all files share is split.
    """
    origins = rows.where("(notice or folder) and code is not null").select("code").distinct().withColumn("copied", F.lit(True))
    return lookup(rows, origins, ["code"])


def sorts(files: DataFrame, train_files: int = TRAIN_FILES, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, repo, path, sort, decided_by, score): sort is 'tool' (generated, minified or data), 'third_party' or null for hand-written."""
    rows = measured(files)
    decided = _decided(_scored(_with_copies(rows), _forest(rows, train_files)), threshold)
    return decided.select("file_id", "repo", "path", "sort", "decided_by", F.round("score", 6).alias("score"))


def deciders(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(sort, decided_by, n_files, n_forest): how many files each evidence decides, and how many of them the forest alone would find."""
    return sorts(files, threshold=threshold).groupBy("sort", "decided_by").agg(F.count("*").alias("n_files"), F.count_if(F.col("score") >= threshold).alias("n_forest"))


def held_out(files: DataFrame, train_files: int = TRAIN_FILES, threshold: float = THRESHOLD) -> DataFrame:
    """One row on the half of the files that the forest has not seen: (n_files, n_tool, n_forest, n_both, recall, precision, labelled_recall).

    n_tool are the files that the combined result, made from all files, calls a tool's, without third-party ones; n_forest those
    that a forest trained on the other half finds without looking at notices; labelled_recall is its recall of files with a notice.
    """
    rows = _with_copies(measured(files))
    half = F.pmod(F.xxhash64("file_id", F.lit(SEED + 1)), F.lit(2))
    whole, seen = _forest(rows, train_files), _forest(rows.where(half == 0), train_files)
    rest = rows.where(half == 1)
    truth = _decided(_scored(rest, whole), threshold).where("sort is null or sort = 'tool'").select("file_id", "label", (F.col("sort") == "tool").alias("tool"))
    found = _scored(rest, seen).select("file_id", (F.col("score") >= threshold).alias("forest"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = lambda c: F.count_if(c)
    both, tool, forest, marked = yes(F.col("tool")) & yes(F.col("forest")), yes(F.col("tool")), yes(F.col("forest")), F.col("label").isin(1, 2)
    sums = truth.join(found, "file_id").agg(F.count("*").alias("n_files"), n(tool).alias("n_tool"), n(forest).alias("n_forest"), n(both).alias("n_both"), n(marked & forest).alias("_m"), n(marked).alias("_k"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return sums.select("n_files", "n_tool", "n_forest", "n_both", rate("n_both", "n_tool").alias("recall"), rate("n_both", "n_forest").alias("precision"), rate("_m", "_k").alias("labelled_recall"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id) of each generated, minified, vendored or data file."""
    return sorts(files).where("sort is not null").select("file_id")


def report(files: DataFrame) -> DataFrame:
    """(repo, n_files, n_tool, n_third_party, handwritten_rate)."""
    tool, third = F.count_if(F.col("sort") == "tool"), F.count_if(F.col("sort") == "third_party")
    n = F.count("*")
    return sorts(files).groupBy("repo").agg(n.alias("n_files"), tool.alias("n_tool"), third.alias("n_third_party"), F.round(1 - (tool + third) / n, 6).alias("handwritten_rate"))
