"""Functions of Rust sources: ``fn`` with a body, anywhere, and closures bound by ``let`` to a name.

Signatures without a body, closures in other places and all text inside macro
calls, macro definitions and attributes don't count.
"""

from __future__ import annotations

import re

from commitlens.operators.extract.lexer import Found, Tokens

_OUTSIDE = re.compile(
    r"""(?P<comment>//[^\n]*)
    |(?P<open>/\*)
    |(?P<string>b?c?r(?P<hash>\#*)".*?"(?P=hash)|[bc]?"(?:\\.|[^"\\])*"?)
    |(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])')
    |(?P<lifetime>'[^\W\d]\w*)
    |(?P<word>(?:r\#)?[^\W\d]\w*)
    |(?P<number>\d[\w.]*)
    |(?P<punct>->|=>|==|!=|<=|>=|&&|\|\||::|[^\s\w])""",
    re.S | re.X,
)


def _without_block_comments(text: str) -> str:
    """Block comments, which nest, as blanks; line feeds stay."""
    out, at = [], 0
    while m := _OUTSIDE.search(text, at):
        out.append(text[at : m.end()] if m.lastgroup != "open" else text[at : m.start()])
        at = m.end()
        if m.lastgroup == "open":
            depth, k = 1, m.end()
            while depth:
                n = re.compile(r"/\*|\*/").search(text, k)
                if not n:
                    k = len(text)
                    break
                depth += 1 if n[0] == "/*" else -1
                k = n.end()
            out.append(re.sub(r"[^\n]", " ", text[m.start() : k]))
            at = k
    return "".join([*out, text[at:]])


def _has_body(t: Tokens, i: int) -> bool:
    """Whether a signature that goes on at i ends in a block rather than a semicolon."""
    while i < len(t):
        x = t[i].text if t[i].kind == "punct" else ""
        if x == "{":
            return True
        if x in (";", "}"):
            return False
        i = t.after_group(i) if x in ("(", "[") else i + 1
    return False


def _bound_closure(t: Tokens, i: int) -> bool:
    """Whether a ``let`` whose name stands before i binds a closure."""
    if t[i].text == ":":
        angle = 0
        i += 1
        while i < len(t) and not (t[i].text == "=" and angle <= 0):
            x = t[i].text if t[i].kind == "punct" else ""
            if x in (";", "{", "}"):
                return False
            angle += (x == "<") - (x == ">")
            i = t.after_group(i) if x in ("(", "[") else i + 1
    if t[i].text != "=":
        return False
    i += 1
    while t[i].kind == "word" and t[i].text in ("move", "async", "static"):
        i += 1
    return t[i].kind == "punct" and t[i].text in ("|", "||")


def functions(text: str) -> list[Found]:
    t = Tokens(_without_block_comments(text), _OUTSIDE, frozenset({"comment", "open"}))
    out: list[Found] = []
    i = 0
    while i < len(t):
        x = t[i]
        if x.kind == "punct" and x.text == "#" and (t[i + 1].text == "[" or t[i + 1].text == "!" and t[i + 2].text == "["):
            i = t.after_group(i + 1 if t[i + 1].text == "[" else i + 2)
            continue
        if x.kind == "word" and t[i + 1].text == "!" and t[i + 1].kind == "punct":
            k = i + 3 if t[i + 2].kind == "word" else i + 2
            if t[k].kind == "punct" and t[k].text in ("(", "[", "{"):
                i = t.after_group(k)
                continue
        if x.kind == "word" and x.text == "fn" and t[i + 1].kind == "word":
            if _has_body(t, i + 2):
                out.append(Found(t[i + 1].line, t[i + 1].text))
            i += 2
            continue
        if x.kind == "word" and x.text == "let" and t[i - 1].text not in ("if", "while", "&&") or x.kind == "word" and x.text == "let" and i == 0:
            k = i + 2 if t[i + 1].text == "mut" else i + 1
            if t[k].kind == "word" and _bound_closure(t, k + 1):
                out.append(Found(t[k].line, t[k].text))
        i += 1
    return out
