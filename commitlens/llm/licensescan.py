"""License scans: exact set-similarity join of text blocks with templates.

DataFrame functions only. A template's tokens are ordered by how many
documents hold them, rarest first. A block meets a template when it contains
at least ``THRESHOLD`` of the template's distinct tokens, that is ``need`` of
them. Then

* prefix filter: one of the template's first ``size - need + 1`` tokens occurs
  in the block, so blocks are joined with templates on these tokens alone;
* length filter: the block has at least ``need`` tokens of the vocabulary;
* positional filter: if the first shared token stands at place i of the
  template and j of the block (both in the global order), no more than
  1 + min(what follows each) tokens can be shared, which must reach ``need``.

Pairs that pass are verified by the size of the intersection.

A text is put in its normal form once: one pass makes the base columns and the
tokens of the vocabulary that it holds, and, where these reach ``need`` of some
template (the length filter for the whole text), its blocks, cut down to the
vocabulary. The join goes over what this pass leaves.

A block is a line, and of a line of more than ``BLOCK`` words each window of
``BLOCK`` words at steps of half of that. The words of the whole text give
windows in the same way, line breaks being separators, so a notice that is
wrapped lies whole in some block. Words are runs of 0-9, a-z (A-Z in
lower case) and all code points above 127.

The template list is fixed, so the vocabulary, whose document counts are read
to the driver, has a fixed size. Nulls count as empty texts; a text without
words has no block and no label. A long text is one row of a task, with memory in
proportion. Tokens that equally many documents hold are ordered by name; labels by
name. Repeated rows each get their own result. An empty table gives an empty
result. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.shared import cut, numbered, small

THRESHOLD = 0.8
BLOCK = 64

# Phrases that count wherever their words stand consecutively.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Sentences of public licence notices, one label each.
TEMPLATES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "bsd"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty", "gpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "zlib"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("distributed under the boost software license version 1 0", "boost"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spaced(low: Column) -> Column:
    """Every word with a space before and one after it: neighbours share none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, SEPARATORS, "  ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base_columns(flat: Column) -> dict[str, Column]:
    """Counts and places of the phrases in a spaced text."""
    some = F.rlike(flat, F.lit("|".join(p.replace(" ", "  ") for p, _ in PHRASES)))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        p = " " + phrase.replace(" ", "  ") + " "
        at, back = F.instr(flat, p), F.instr(F.reverse(flat), p[::-1])
        counts.append((F.length(flat) - F.length(F.replace(flat, F.lit(p), F.lit("")))) / len(p))
        firsts.append(F.when(at > 0, _spaces(F.substr(flat, F.lit(1), at - 1)) / 2))
        last = F.length(flat) - back + 1 - len(p)
        lasts.append(F.when(back > 0, _spaces(F.substr(flat, F.lit(1), last)) / 2))
        labels.append(F.when(at > 0, F.lit(label)))
    return {
        "n_words": F.when(flat == "  ", F.lit(0)).otherwise(_spaces(flat) / 2).cast("long"),
        "n_base": F.when(some, reduce(lambda a, b: a + b, counts)).otherwise(F.lit(0)).cast("long"),
        "first_word": F.when(some, F.array_min(F.array_compact(F.array(*firsts)))).cast("long"),
        "last_word": F.when(some, F.array_max(F.array_compact(F.array(*lasts)))).cast("long"),
        "base": F.when(some, F.array_sort(F.array_compact(F.array(*labels)))).otherwise(F.array().cast("array<string>")),
    }


def _needs() -> list[tuple[str, list[str], int]]:
    """Label, distinct tokens and the least number of them, of each template."""
    tokens = [(label, sorted(set(text.split()))) for text, label in TEMPLATES]
    return [(label, t, -(-len(t) * round(THRESHOLD * 1000) // 1000)) for label, t in tokens]


VOCABULARY = sorted({t for text, _ in TEMPLATES for t in text.split()})


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _blocks(text: Column) -> Column:
    """The words of each block: of lines, and of a text of several lines as a whole."""
    parts = F.split(text, "\n")
    parts = F.when(F.size(parts) > 1, F.concat(parts, F.array(text))).otherwise(parts)
    lines = F.transform(parts, lambda x: F.array_remove(F.split(F.trim(F.regexp_replace(x, SEPARATORS, " ")), " "), ""))
    half = BLOCK // 2
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(w) - BLOCK) / half).cast("int"))),
        lambda k: F.slice(w, k * half + 1, F.lit(BLOCK)),
    )
    return F.flatten(F.transform(F.filter(lines, lambda w: F.size(w) > 0), cut))


def template_hits(blocks: DataFrame, counts: dict[str, int]) -> DataFrame:
    """row, label, share: of blocks (row, words) the best containment of a template's tokens, by row and label. ``counts`` order the tokens."""
    spark = blocks.sparkSession
    ranked = sorted(VOCABULARY, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(ranked)}
    index, sizes = [], []
    for k, (label, words, need) in enumerate(_needs()):
        tokens = sorted(rank[t] for t in words)
        sizes.append((k, label, len(tokens), need, tokens))
        index += [(tokens[i], k, i) for i in range(len(tokens) - need + 1)]
    prefix = spark.createDataFrame(index, "token int, template int, place int")
    templates = spark.createDataFrame(sizes, "template int, label string, size int, need int, tokens array<int>")
    ranks = F.create_map(*[F.lit(x) for t in ranked for x in (t, rank[t])])
    blocks = blocks.select("row", F.array_sort(F.transform("words", lambda w: F.element_at(ranks, w))).alias("held"))
    seeds = blocks.select("row", "held", F.posexplode("held").alias("at", "token"))
    pairs = seeds.join(F.broadcast(prefix), "token").join(F.broadcast(templates), "template")
    pairs = pairs.where(F.size("held") >= F.col("need"))
    pairs = pairs.where(1 + F.least(F.col("size") - F.col("place") - 1, F.size("held") - F.col("at") - 1) + F.least("place", "at") >= F.col("need"))
    shared = F.size(F.array_intersect("held", "tokens"))
    met = pairs.where(shared >= F.col("need")).withColumn("share", shared / F.col("size"))
    return met.groupBy("row", "label").agg(F.max("share").alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``base_columns``, base_labels, labels and score.

    ``score`` is 1 with a base place, else the best containment that met the threshold, else 0.
    """
    known = _array(VOCABULARY)
    flat = docs.select("doc_id", "text", spaced(lowered(F.col("text"))).alias("flat"))
    flat = flat.withColumn("held", F.array_intersect(F.split("flat", " +"), known))
    able = reduce(lambda a, b: a | b, (F.size(F.array_intersect("held", _array(t))) >= need for _, t, need in _needs()))
    least = min(need for _, _, need in _needs())
    cut_down = F.filter(F.transform(_blocks(lowered(F.col("text"))), lambda w: F.array_intersect(w, known)), lambda w: F.size(w) >= least)
    flat = flat.select("doc_id", "held", *(c.alias(n) for n, c in base_columns(F.col("flat")).items()), F.when(able, cut_down).alias("blocks"))
    slim = numbered(flat, "row")
    counts = {r["token"]: r["n"] for r in slim.select(F.explode("held").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    hits = template_hits(slim.select("row", F.explode("blocks").alias("words")), counts)
    hits = hits.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    both = slim.join(small(cut(hits)), "row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The scan in SQL: every block against every template."""
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    at = [f"list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {listed(p.split())})" for p, _ in PHRASES]
    labels = [f"case when len(at{k}) > 0 then '{label}' end" for k, (_, label) in enumerate(PHRASES)]
    templates = ", ".join(f"('{label}', {listed(tokens)}, {need})" for label, tokens, need in _needs())
    half = BLOCK // 2
    return f"""
with t as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as x from documents),
w as (select r, doc_id, {words.format('x')} as w, string_split(x, chr(10)) as l, x from t),
b as materialized (select r, doc_id, w, {', '.join(f'{a} as at{k}' for k, a in enumerate(at))} from w),
p as (select r, {words.format('part')} as v from (select r, unnest(case when len(l) > 1 then list_append(l, x) else l end) as part from w)),
i as (select r, v, unnest(range(0, 1 + greatest(0, ceil((len(v) - {BLOCK}) / {half}))::bigint)) as i from p where len(v) > 0),
k as (select r, list_distinct(v[i * {half} + 1 : i * {half} + {BLOCK}]) as v from i),
q as materialized (select r, v from k where len(list_intersect(v, {listed(VOCABULARY)})) >= {min(need for _, _, need in _needs())}),
h as (select r, label, len(list_intersect(v, tokens)) / len(tokens) as share from q, (values {templates}) y(label, tokens, need) where len(list_intersect(v, tokens)) >= need),
g as (select r, list_distinct(list(label)) as found, max(share) as share from h group by 1),
c as (select b.*, list_concat({', '.join(f'at{k}' for k in range(len(at)))}) as places,
             list_sort(list_filter(list_distinct([{', '.join(labels)}]), lambda v: v is not null)) as base from b)
select doc_id, len(w)::bigint as n_words, len(places)::bigint as n_base, list_min(places)::bigint as first_word, list_max(places)::bigint as last_word,
       array_to_string(base, ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') as labels,
       case when len(places) > 0 then 1.0::double else coalesce(share, 0)::double end as score
from c left join g on c.r = g.r
"""


OP6_SQL = _sql()
