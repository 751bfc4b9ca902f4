"""Predicates and forms of names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of names.
PASCAL = r"^[A-Z][A-Za-z0-9]*$"
SNAKE = r"^[a-z_][a-z0-9_]*$"
TABLE = r"^[a-z][a-z0-9_]*$"
CAMEL = r"^[a-z][A-Za-z0-9]*$"
OPERATION = r"^[a-z][A-Za-z0-9]*\(\)$"
EVENT = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)+$"
SNAKE_LANGUAGES = ("Rust", "Go", "Python", "Ruby", "PHP")


def is_pascal(name: Column) -> Column:
    return name.rlike(PASCAL)


def follows_convention(name: Column, language: Column) -> Column:
    """Snake case, or a name that starts with __ or test_, where the language has it; else camel case, constructor, or a name that starts with $ or #."""
    snake = F.startswith(name, F.lit("__")) | F.startswith(name, F.lit("test_")) | name.rlike(SNAKE)
    camel = (name == "constructor") | name.rlike(r"^[$#]") | name.rlike(CAMEL)
    return F.when(language.isin(*SNAKE_LANGUAGES), snake).otherwise(camel)


def convention(language: Column) -> Column:
    return F.when(language.isin(*SNAKE_LANGUAGES), "snake_case").otherwise("camelCase")


def humanized(name: Column) -> Column:
    """Words between - and _ with their first letter in upper case and the rest as it is."""
    words = F.filter(F.split(name, "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def stripped(text: Column) -> Column:
    """Without quotes of any kind at both ends."""
    return F.btrim(text, F.lit("\"'`"))


def decorator_name(text: Column) -> Column:
    return F.trim(F.substring_index(text, "(", 1))


def decorator_arg(text: Column) -> Column:
    """What stands between the first ( and the last ), trimmed and without quotes; '' without parentheses."""
    return stripped(F.trim(F.regexp_extract(text, r"\(([\s\S]*)\)", 1)))
