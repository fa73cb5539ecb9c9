"""Tokens of a source text, and walking over them."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Found(NamedTuple):
    line: int
    name: str
    receiver: str | None = None
    capture_index: int = 0


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int


CLOSER = {"(": ")", "[": "]", "{": "}"}


class Tokens:
    """The tokens of a text that mean something. ``skip`` names the kinds that don't, such as comments."""

    def __init__(self, text: str, pattern: re.Pattern, skip: frozenset[str]):
        self.text = text
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.all = [Token(m.lastgroup, m[0], m.start(), m.end(), bisect_right(starts, m.start())) for m in pattern.finditer(text) if m.lastgroup not in skip]

    def __len__(self) -> int:
        return len(self.all)

    def __getitem__(self, i: int) -> Token:
        return self.all[i] if 0 <= i < len(self.all) else Token("end", "", len(self.text), len(self.text), 0)

    def after_group(self, i: int) -> int:
        """The place after the bracket that closes the one at i; the end if none does."""
        depth = 0
        while i < len(self.all):
            t = self.all[i]
            if t.kind == "punct":
                if t.text in CLOSER:
                    depth += 1
                elif t.text in ")]}":
                    depth -= 1
                    if depth <= 0:
                        return i + 1
            i += 1
        return i
