"""Functions of Lua sources: ``function f``, ``local function f``, ``function T.f``, ``function T:f``,
``local f = function`` and ``T.f = function``, at any depth.

Longer targets (``a.b.f``), indices in brackets, fields of table constructors
and plain globals that are assigned a function don't count. Of an assignment
with several targets and a function among its values each fitting target counts.
"""

from __future__ import annotations

import re

from commitlens.operators.extract.lexer import Found, Tokens

_TOKEN = re.compile(
    r"""(?P<comment>--\[(?P<eqc>=*)\[.*?(?:\](?P=eqc)\]|\Z)|--[^\n]*)
    |(?P<string>\[(?P<eq>=*)\[.*?(?:\](?P=eq)\]|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)
    |(?P<word>[^\W\d]\w*)
    |(?P<number>\d[\w.]*)
    |(?P<punct>\.\.\.|\.\.|==|~=|<=|>=|::|[^\s\w])""",
    re.S | re.X,
)
_OPEN, _CLOSE = frozenset({"function", "do", "if", "repeat"}), frozenset({"end", "until"})
_BINARY = frozenset({"or", "and", "..", "==", "~=", "<", ">", "<=", ">=", "+", "-", "*", "/", "%", "^", "&", "|", "~"})


def _after_function(t: Tokens, i: int) -> int:
    """The place after the ``end`` of the function at i."""
    depth = 0
    while i < len(t):
        if t[i].kind == "word":
            depth += (t[i].text in _OPEN) - (t[i].text in _CLOSE)
            if not depth:
                return i + 1
        i += 1
    return i


def _has_function(t: Tokens, i: int) -> bool:
    """Whether an element of the expression list at i is a function. Values before it are passed over only if they are simple."""
    while True:
        if t[i].kind == "word" and t[i].text == "function":
            return t[_after_function(t, i)].text not in _BINARY
        if t[i].kind == "punct" and t[i].text in ("{", "("):
            i = t.after_group(i)
        elif t[i].kind in ("word", "number", "string"):
            i += 1
        else:
            return False
        if t[i].text != ",":
            return False
        i += 1


def _targets(t: Tokens, i: int) -> tuple[list[tuple[int, int]], int]:
    """Targets of an assignment at i, as first and last token of each, and the place after them."""
    out = []
    while t[i].kind == "word":
        start = i
        i += 1
        while True:
            if t[i].text == "." and t[i + 1].kind == "word":
                i += 2
            elif t[i].text == "[" and t[i].kind == "punct":
                i = t.after_group(i)
            else:
                break
        out.append((start, i - 1))
        if t[i].text == "<" and t[i + 2].text == ">":
            i += 3
        if t[i].text != ",":
            break
        i += 1
    return out, i


def functions(text: str) -> list[Found]:
    t = Tokens(text, _TOKEN, frozenset({"comment"}))
    out: list[Found] = []
    for i, x in enumerate(t.all):
        if x.kind != "word":
            continue
        if x.text == "function":
            if t[i + 1].kind == "word" and t[i + 2].text == "(":
                out.append(Found(t[i + 1].line, t[i + 1].text))
            elif t[i + 1].kind == "word" and t[i + 2].text in (".", ":") and t[i + 3].kind == "word" and t[i + 4].text == "(":
                out.append(Found(t[i + 3].line, t[i + 3].text))
        elif x.text == "local" and t[i + 1].text != "function":
            targets, k = _targets(t, i + 1)
            if t[k].text == "=" and _has_function(t, k + 1):
                out += [Found(t[a].line, t[a].text) for a, b in targets if a == b]
        elif t[i - 1].text not in (".", ":", ",", "local", "function", "goto", "::") or i == 0:
            targets, k = _targets(t, i)
            if t[k].text == "=" and any(b - a == 2 and t[a + 1].text == "." for a, b in targets) and _has_function(t, k + 1):
                out += [Found(t[b].line, t[b].text) for a, b in targets if b - a == 2 and t[a + 1].text == "."]
    return sorted(out, key=lambda f: f.line)
