"""Languages of paths, and how functions are named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commitlens.languages import REGISTRY


def lang_of(path: Column) -> Column:
    """The language of a path's extension, ``undefined`` for others and none."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit("undefined")
    for lang in REGISTRY.values():
        out = F.when(ext.isin(*lang.extensions), lang.name).otherwise(out)
    return out


def lang_order(lang: Column) -> Column:
    """The place of a language among rows of equal frequency."""
    out = F.lit(len(REGISTRY))
    for k, name in enumerate(REGISTRY):
        out = F.when(lang == name, k).otherwise(out)
    return out


def receiver_type(receiver: Column) -> Column:
    """The second of the receiver's parts at single spaces, else all but its first character."""
    return F.coalesce(F.get(F.split(receiver, " "), F.lit(1)), F.substr(receiver, F.lit(2)))


def qualified_name(receiver: Column, name: Column) -> Column:
    """The name, after its receiver's type where there is one: ``(*T) F``."""
    return F.when(receiver.isNull(), name).otherwise(F.concat(F.lit("("), receiver_type(receiver), F.lit(" "), name))
