"""Functions of Go sources: declarations, methods with their receiver, and function literals that a
statement of a function's own block binds by ``:=``.

Blocks inside that block, ``var`` and package-level variables don't count, nor
do literals that are called on the spot.
"""

from __future__ import annotations

import re

from commitlens.operators.extract.lexer import Found, Tokens

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>`[^`]*`?|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])+'?)
    |(?P<word>[^\W\d]\w*)
    |(?P<number>\d[\w.]*)
    |(?P<punct>:=|\+\+|--|<-|\.\.\.|[^\s\w])""",
    re.S | re.X,
)
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_ENDING_WORDS = frozenset({"break", "continue", "fallthrough", "return"})


def _ends_statement(t: Tokens, i: int) -> bool:
    """Whether a line break after token i ends a statement."""
    x = t[i]
    if x.kind == "word":
        return x.text not in _KEYWORDS or x.text in _ENDING_WORDS
    return x.kind in ("string", "number") or x.text in (")", "]", "}", "++", "--")


def _block(t: Tokens, i: int) -> int:
    """From after a signature's parameters at i: the place of the brace that opens the body, or -1."""
    while i < len(t):
        x = t[i]
        if x.text == "{" and x.kind == "punct":
            return i
        if x.text in ("interface", "struct") and t[i + 1].text == "{":
            i = t.after_group(i + 1)
        elif x.kind == "punct" and x.text in ("(", "["):
            i = t.after_group(i)
        elif x.text in (";", ",", "}", ")", ":=", "="):
            return -1
        else:
            i += 1
        if i < len(t) and t[i].line > t[i - 1].line and _ends_statement(t, i - 1):
            return -1
    return -1


def _literals(t: Tokens, i: int) -> int:
    """How many elements of the expression list at i are function literals themselves."""
    n = 0
    while True:
        if t[i].text == "func" and t[i + 1].text == "(":
            body = _block(t, t.after_group(i + 1))
            if body < 0:
                return n
            i = t.after_group(body)
            broken = i < len(t) and t[i].line > t[i - 1].line
            n += broken or t[i].kind == "end" or t[i].text in (",", ";", "}")
            if broken:
                return n
        while i < len(t) and t[i].text not in (",", ";", "}", ")"):
            nxt = t.after_group(i) if t[i].kind == "punct" and t[i].text in ("(", "[", "{") else i + 1
            if nxt < len(t) and t[nxt].line > t[nxt - 1].line and _ends_statement(t, nxt - 1):
                return n
            i = nxt
        if t[i].text != ",":
            return n
        i += 1


def _bound(t: Tokens, i: int, out: list[Found]) -> None:
    """Literals that statements of the block at i bind."""
    end = t.after_group(i)
    start = i + 1
    k = start
    while k < end - 1:
        if k > start and (t[k - 1].text == ";" or t[k].line > t[k - 1].line and _ends_statement(t, k - 1)):
            start = k
        if t[k].text == ":=" and not (t[start].kind == "word" and t[start].text in _KEYWORDS) and k > start:
            name = t.text[t[start].start : t[k - 1].end]
            out += [Found(t[start].line, name, None, 1)] * _literals(t, k + 1)
        k = t.after_group(k) if t[k].kind == "punct" and t[k].text in ("(", "[", "{") else k + 1


def functions(text: str) -> list[Found]:
    t = Tokens(text, _TOKEN, frozenset({"comment"}))
    out: list[Found] = []
    i = 0
    while i < len(t):
        x = t[i]
        if x.text == "func" and x.kind == "word" and (i == 0 or t[i - 1].line < x.line or t[i - 1].text in (";", "}")):
            receiver, k = None, i + 1
            if t[k].text == "(":
                k = t.after_group(k)
                receiver = t.text[t[i + 1].start : t[k - 1].end]
            if t[k].kind == "word" and t[k].text not in _KEYWORDS:
                out.append(Found(t[k].line, t[k].text, receiver, 1))
                k += 1
                while t[k].text == "[":
                    k = t.after_group(k)
                if t[k].text == "(":
                    k = t.after_group(k)
                    body = _block(t, k)
                    if body >= 0:
                        _bound(t, body, out)
                        k = t.after_group(body)
                i = k
                continue
        i = t.after_group(i) if x.kind == "punct" and x.text in ("(", "[", "{") else i + 1
    return out
