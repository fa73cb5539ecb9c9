"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams
that any match must contain (lower-cased, so one index serves rules in either
case). Every step of a scan indexes its texts: postings of those trigrams that
some rule asks for. A rule's candidates are the texts that satisfy its query;
only those are searched with the expression itself. A rule without mandatory
trigrams scans every text; if it is one character class repeated, the scan for
runs of that class goes over the whole column at once.

The index is built over whole texts and lives as long as the step that made
it, so the scan needs no shuffle, its memory is that of one step, and a lost
executor costs the steps it had.

Nulls count as empty texts, for which nothing is found. A long text is one step
by itself. Repeated rows each get their own result. Spans are in code points,
end exclusive; those that start at the same place come in the rules' order. An
empty table gives an empty result. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from commitlens.llm import textkit

# The kinds that every scan reports first, in this order, as (kind, expression, group to measure, least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+", re.A), 0, 32),
)
# Public formats of further credentials.
MORE = (
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}", re.A), 0, 40),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}", re.A), 0, 15),
    ("google", re.compile(r"AIza[A-Za-z0-9_-]{35}", re.A), 0, 39),
    ("stripe", re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}", re.A), 0, 24),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A), 0, 30),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A), 0, 27),
    ("bearer", re.compile(r"bearer\x20+[A-Za-z0-9._~+/=-]{16,}", re.A | re.I), 0, 23),
)
RULES = BASE + MORE

#: A query is True (no condition), a trigram, ("and", queries) or ("or", queries).
Query = bool | bytes | tuple


def trigram_query(pattern: re.Pattern) -> Query:
    """What trigrams (ASCII, lower case) any match contains, from the parsed expression."""
    parsed = _parser.parse(pattern.pattern, pattern.flags & ~re.U)
    return _simplify(("and", _need([(op, arg) for op, arg in parsed])))


def _need(items: list, limit: int = 64) -> list[Query]:
    """Queries that all hold for a match of a sequence. ``run``: the strings that may have just been read, to join over borders."""
    found: list[Query] = []
    run: list[str] = [""]

    def close() -> None:
        nonlocal run
        found.append(_strings(run))
        run = [""]

    for op, arg in items:
        exact = _exact(op, arg)
        if exact and len(run) * len(exact) <= limit:
            run = [a + b for a in run for b in exact]
            continue
        close()
        if exact:
            run = exact
        elif op is C.SUBPATTERN:
            found += _need(list(arg[3]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            found += _need(list(arg[2]) * min(arg[0], 3))
        elif op is C.BRANCH:
            found.append(("or", [_simplify(("and", _need(list(b)))) for b in arg[1]]))
    close()
    return found


def _exact(op, arg, limit: int = 16) -> list[str] | None:
    """All strings that an item matches, in lower case, if they are few."""
    if op is C.LITERAL:
        return [chr(arg).lower()] if arg < 128 else None
    if op is C.IN and all(k is C.LITERAL and v < 128 for k, v in arg):
        return sorted({chr(v).lower() for _, v in arg})
    if op is C.SUBPATTERN:
        return _sequence(arg[3], limit)
    if op is C.BRANCH:
        parts = [_sequence(b, limit) for b in arg[1]]
        return sorted({x for p in parts for x in p}) if all(parts) and sum(map(len, parts)) <= limit else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 4:
        one = _sequence(arg[2], limit)
        if one:
            out, power = [], [""]
            for k in range(arg[1] + 1):
                if k >= arg[0]:
                    out += power
                power = [a + b for a in power for b in one]
                if len(out) + len(power) > limit:
                    return None
            return sorted(set(out))
    return None


def _sequence(items, limit: int) -> list[str] | None:
    out = [""]
    for op, arg in items:
        one = _exact(op, arg, limit)
        if not one or len(out) * len(one) > limit:
            return None
        out = [a + b for a in out for b in one]
    return out


def _strings(texts: list[str]) -> Query:
    """One of the strings occurs."""
    if any(len(x) < 3 for x in texts):
        return True
    return ("or", [("and", [x[i : i + 3].encode() for i in range(len(x) - 2)]) for x in texts])


def _simplify(q: Query) -> Query:
    if not isinstance(q, tuple):
        return q
    kind, parts = q[0], [_simplify(x) for x in q[1]]
    if kind == "or" and any(x is True for x in parts):
        return True
    parts = list(dict.fromkeys(x if not isinstance(x, tuple) else (x[0], tuple(x[1])) for x in parts if x is not True))
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _trigrams(q: Query) -> set[bytes]:
    return {q} if isinstance(q, bytes) else set().union(*map(_trigrams, q[1])) if isinstance(q, tuple) else set()


def postings(low: np.ndarray, offs: np.ndarray, wanted: list[bytes]) -> dict[bytes, set[int]]:
    """Trigram -> the texts that contain it, for the wanted ones. ``low``: the texts' bytes in lower case."""
    n = int(offs[-1])
    out: dict[bytes, set[int]] = {t: set() for t in wanted}
    if n < 3 or not wanted:
        return out
    firsts = np.zeros(256, bool)
    firsts[[t[0] for t in wanted]] = True
    pairs = np.zeros(65536, bool)
    pairs[[t[0] << 8 | t[1] for t in wanted]] = True
    at = np.flatnonzero(firsts[low[: n - 2]])
    at = at[pairs[low[at].astype(np.int32) << 8 | low[at + 1]]]
    code = low[at].astype(np.int32) << 16 | low[at + 1].astype(np.int32) << 8 | low[at + 2]
    names = np.array(sorted(t[0] << 16 | t[1] << 8 | t[2] for t in wanted), np.int32)
    k = np.minimum(np.searchsorted(names, code), len(names) - 1)
    good = names[k] == code
    at, k = at[good], k[good]
    text = np.searchsorted(offs, at, side="right") - 1
    inside = at + 3 <= offs[text + 1]
    for pair in np.unique(k[inside].astype(np.int64) * len(offs) + text[inside]).tolist():
        name = int(names[pair // len(offs)])
        out[bytes((name >> 16, name >> 8 & 255, name & 255))].add(pair % len(offs))
    return out


def candidates(q: Query, index: dict[bytes, set[int]], n: int) -> set[int]:
    if q is True:
        return set(range(n))
    if isinstance(q, bytes):
        return index[q]
    parts = [candidates(x, index, n) for x in q[1]]
    return set.intersection(*parts) if q[0] == "and" else set.union(*parts)


def run_class(pattern: re.Pattern) -> np.ndarray | None:
    """The ASCII characters of an expression that is one of them repeated, ``[...]+``; None for others."""
    parsed = list(_parser.parse(pattern.pattern, pattern.flags & ~re.U))
    if pattern.flags & re.I or len(parsed) != 1 or parsed[0][0] is not C.MAX_REPEAT or parsed[0][1][1] is not C.MAXREPEAT or len(parsed[0][1][2]) != 1:
        return None
    op, arg = parsed[0][1][2][0]
    out = np.zeros(256, bool)
    for kind, value in [(op, arg)] if op is C.LITERAL else arg if op is C.IN else [(None, None)]:
        if kind is C.LITERAL and value < 128:
            out[value] = True
        elif kind is C.RANGE and value[1] < 128:
            out[value[0] : value[1] + 1] = True
        else:
            return None
    return out


def _with_runs(buf: np.ndarray, offs: np.ndarray, chars: np.ndarray, least: int) -> set[int]:
    """A full scan for a repeated character: the texts with a run of at least so many."""
    n = int(offs[-1])
    if not n:
        return set()
    border = np.union1d(np.flatnonzero(~chars[buf[:n]]), offs[1:] - 0.5)
    border = np.concatenate(([-1.0], border, [n]))
    long = border[:-1][np.diff(border) > least - 0.5]
    return set((np.searchsorted(offs, np.floor(long) + 1, side="right") - 1).tolist())


def _found(rule, text: str) -> list[tuple[int, int, str]]:
    kind, pattern, group, least = rule
    return [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def scan(docs: DataFrame, rules=RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id; n_<kind> of each base kind; base_sha256; spans: kind:start:end of all rules, by start, then by the rules' order."""
    queries = [trigram_query(r[1]) for r in rules]
    wanted = sorted(set().union(*map(_trigrams, queries)))
    kinds = [r[0] for r in rules]
    classes = [run_class(r[1]) if q is True else None for r, q in zip(rules, queries, strict=True)]
    counts = ", ".join(f"n_{k} long" for k in kinds[:base])

    def step(batches):
        for b in textkit.slices(batches):
            ids, texts = b.column(0), b.column(1)
            buf, offs = textkit.text_buffer(texts)
            low = textkit.lower_ascii(buf)
            n = b.num_rows
            index = postings(low, offs, wanted)
            spans: list[list] = [[] for _ in range(n)]
            for k, (rule, q) in enumerate(zip(rules, queries, strict=True)):
                chars = classes[k]
                for i in candidates(q, index, n) if chars is None else _with_runs(buf, offs, chars, rule[3]):
                    if i < n and (text := texts[i].as_py()):
                        spans[i] += [(s, k, e) for s, e, _ in _found(rule, text)]
            out_counts = [[0] * n for _ in range(base)]
            digests, named = [], []
            for i, found in enumerate(spans):
                found.sort()
                for _, k, _ in found:
                    if k < base:
                        out_counts[k][i] += 1
                digests.append(hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found if k < base).encode()).hexdigest())
                named.append(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found))
            columns = [ids, *(pa.array(c, pa.int64()) for c in out_counts), pa.array(digests, pa.string()), pa.array(named, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The scan in SQL: pieces between matches give the matches' places."""

    def pattern(expression: re.Pattern) -> str:
        # Letters in either case are spelt out where a rule doesn't mind case, as folding in SQL isn't of ASCII alone.
        out, inside = "", False
        for i, c in enumerate(expression.pattern):
            inside = c == "[" or inside and c != "]"
            plain = c.isalpha() and not inside and expression.pattern[i - 1 : i] != "\\"
            out += f"[{c.upper()}{c.lower()}]" if plain and expression.flags & re.I and expression.pattern[i - 2 : i] != "\\x" else c
        return out.replace("'", "''")

    one = "select r, {k} as k, '{kind}' as kind, {least} as least, string_split_regex(x, '{p}') as p, regexp_extract_all(x, '{p}') as w, regexp_extract_all(x, '{p}', {group}) as g from t"
    every = " union all ".join(one.format(k=k, kind=r[0], p=pattern(r[1]), group=r[2], least=r[3]) for k, r in enumerate(RULES))
    counts = ", ".join(f"(count(*) filter (k = {k}))::bigint as n_{r[0]}" for k, r in enumerate(BASE))
    said = lambda keep: f"coalesce(string_agg(kind || ':' || a || ':' || z, ',' order by a, k) filter ({keep}), '')"
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
m as (select r, k, kind, least, p, w, g, unnest(range(1, len(w) + 1)) as i from ({every})),
s as (select r, k, kind, (list_sum(list_transform(p[1 : i], lambda v: length(v))) + coalesce(list_sum(list_transform(w[1 : i - 1], lambda v: length(v))), 0))::bigint as a, length(w[i]) as n
      from m where length(g[i]) >= least),
e as (select *, a + n as z from s),
c as (select r, {counts}, {said(f'k < {len(BASE)}')} as base, {said('true')} as spans from e group by 1)
select doc_id, {', '.join(f'coalesce(n_{r[0]}, 0) as n_{r[0]}' for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join c on t.r = c.r
"""


OP10_SQL = _sql()
