"""The languages whose functions can be extracted: the one place where a language is added.

``register`` takes a name, the file extensions and an extractor: a function of a
file's text that gives its functions in order (``lexer.Found``) and never fails on
bad syntax. The order of registration is the order in which rows of equal
frequency are listed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from commitlens.operators.extract import go, lua, rust
from commitlens.operators.extract.lexer import Found


class Language(NamedTuple):
    name: str
    extensions: tuple[str, ...]
    extract: Callable[[str], list[Found]]


REGISTRY: dict[str, Language] = {}


def register(name: str, extensions: tuple[str, ...], extract: Callable[[str], list[Found]]) -> None:
    REGISTRY[name] = Language(name, extensions, extract)


def supported(name: str) -> bool:
    return name in REGISTRY


register("go", ("go",), go.functions)
register("rust", ("rs",), rust.functions)
register("lua", ("lua",), lua.functions)
