"""Checks of what users pass in: texts, paths, ids, patterns, JSON."""

from __future__ import annotations

import json
import os
import re

# Limits of inputs.
MAX_TEXT, MAX_PATH, MAX_PATTERN, MAX_JSON, MAX_DEPTH = 10_000, 4_096, 1_024, 1_048_576, 32
CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f]")


class InputError(ValueError):
    """An input that is not accepted; code says why."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def check_text(text: str) -> str:
    if len(text) > MAX_TEXT:
        raise InputError("too_long", f"more than {MAX_TEXT} characters")
    if CONTROL.search(text):
        raise InputError("control_characters", "control characters are not allowed")
    return text


def check_path(path: str, base: str | None = None) -> str:
    """A path without .. components and NUL that stays below base, symbolic links followed."""
    if "\0" in path:
        raise InputError("nul", "NUL in a path")
    if len(path.encode()) > MAX_PATH:
        raise InputError("too_long", f"more than {MAX_PATH} bytes")
    if ".." in path.replace("\\", "/").split("/"):
        raise InputError("traversal", ".. in a path")
    if base is not None:
        root = os.path.realpath(base)
        if os.path.commonpath([root, os.path.realpath(os.path.join(root, path))]) != root:
            raise InputError("outside", "a path outside its base")
    return path


def check_id(ident: str) -> str:
    if not ident or re.search(r"[?#%]", ident):
        raise InputError("bad_id", "an id is not empty and has no ?, # or %")
    return check_text(ident)


def check_pattern(pattern: str) -> str:
    if len(pattern) > MAX_PATTERN:
        raise InputError("too_long", f"more than {MAX_PATTERN} characters")
    try:
        re.compile(pattern)
    except re.error as e:
        raise InputError("bad_pattern", str(e)) from None
    return pattern


def depth(value: object) -> int:
    """Levels of nesting; a scalar has none."""
    level, at = 0, [value]
    while at := [y for x in at if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)] or ([None] if any(isinstance(x, (dict, list)) for x in at) else []):
        level += 1
        if not any(isinstance(x, (dict, list)) for x in at):
            break
    return level


def check_json(text: str) -> object:
    if len(text.encode()) > MAX_JSON:
        raise InputError("too_long", f"more than {MAX_JSON} bytes")
    try:
        value = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise InputError("bad_json", str(e)) from None
    if depth(value) > MAX_DEPTH:
        raise InputError("too_deep", f"more than {MAX_DEPTH} levels")
    return value


def payload(text: str, allowed: set[str], flags: dict[str, object]) -> dict:
    """Options from a JSON object; unknown ones and ones that flags also set are errors."""
    data = check_json(text)
    if not isinstance(data, dict):
        raise InputError("bad_json", "an object is needed")
    if unknown := sorted(set(data) - allowed):
        raise InputError("unknown_field", f"unknown fields {', '.join(unknown)}")
    if both := sorted(k for k in data if flags.get(k) not in (None, False)):
        raise InputError("conflict", f"{', '.join(both)} given twice")
    return data
