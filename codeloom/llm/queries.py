"""Queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import canonical, handwritten, mixing, packing, syntax
from codeloom.runtime import read


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.unparsable(read(spark, root, "walked_files"))


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    return syntax.report(read(spark, root, "walked_files"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.not_handwritten(read(spark, root, "walked_files"))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.report(read(spark, root, "walked_files"))


def p5_deciders(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.deciders(read(spark, root, "walked_files"))


def p5_held_out(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.held_out(read(spark, root, "walked_files"))


def _windows(spark: SparkSession, root: str) -> DataFrame:
    return packing.windows(*(read(spark, root, x) for x in ("documents", "context_windows", "source_mix")))


def p6_windows(spark: SparkSession, root: str) -> DataFrame:
    return _windows(spark, root)


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return packing.report(_windows(spark, root), read(spark, root, "context_windows"))


def p6_shares(spark: SparkSession, root: str) -> DataFrame:
    return packing.shares(_windows(spark, root), read(spark, root, "source_mix"))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read(spark, root, "documents"), read(spark, root, "source_mix"))


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    return mixing.report(p7_mix(spark, root), read(spark, root, "source_mix"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return canonical.same_looking(read(spark, root, "documents"))


def p8_canonical(spark: SparkSession, root: str) -> DataFrame:
    return canonical.canonical_rows(read(spark, root, "documents"))


def p8_classes(spark: SparkSession, root: str) -> DataFrame:
    return canonical.classes(read(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p5_report, p5_deciders, p5_held_out, p6_windows, p6_report, p6_shares, p7_mix, p7_report, p8_found, p8_canonical, p8_classes)}
SQL: dict[str, str] = {}
