"""Filters on paths, languages and names, as conditions that reach the scan."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.languages import REGISTRY


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_prefix(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether the path is, or is below, one of the prefixes, by whole components. No prefixes: true.

    A leading ``./`` counts as a component of its own; an empty prefix or ``.`` is above everything.
    """
    if not prefixes:
        return F.lit(True)
    out = []
    for p in prefixes:
        lead = "./" if p.startswith("./") else ""
        clean = posixpath.normpath(p) if p else "."
        if clean in (".", ""):
            return F.lit(True)
        clean = clean if clean.startswith("/") else lead + clean
        out += [path == clean, path.startswith(clean.rstrip("/") + "/")]
    return any_of(out)


def contains_none(text: Column, terms: Sequence[str]) -> Column:
    """Whether none of the terms occurs, case and all. No terms: true; an empty term occurs everywhere."""
    return ~any_of([text.contains(t) for t in terms]) if terms else F.lit(True)


def is_visible(path: Column) -> Column:
    """Whether the file's own name starts with another character than a dot; hidden folders don't matter."""
    return ~F.substring_index(path, "/", -1).startswith(".")


def is_supported(lang: Column) -> Column:
    return lang.isin(*REGISTRY)
