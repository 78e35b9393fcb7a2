"""Licence scan by a positional rare-token index (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.llm.common import table

#: Fixed base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed template passages of public licences: label, words, mandatory key phrase (a part of the words).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied artistic license", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain cc0 1 0 universal", "cc0 1 0 universal"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license agreement", "eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text_literal(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def license_hits(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits): positions of the vocabulary's words among all words of each text."""
    # letters of both cases count as word characters here; folding a few hits is cheaper than folding whole texts
    split = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), split.alias("words"))
    fold = f"translate(x, '{UPPER}', '{LOWER}')"
    hits = f"filter(transform(words, (x, i) -> if(octet_length(x) <= {max(map(len, vocabulary))} and lower(x) in ({_text_literal(vocabulary)}), named_struct('w', {fold}, 'p', i), null)), x -> x is not null and x.w in ({_text_literal(vocabulary)}))"
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(hits).alias("hits"))


def _key_at(body: list[str], key: list[str]) -> range:
    """The places of the key phrase among a template's words."""
    at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
    return range(at, at + len(key))


def license_scan(docs: DataFrame, anchors: int = 4, min_anchors: int = 2, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per document.

    1. Every text is cut into words; the positions of template words (a fixed vocabulary) are kept.
    2. Their document frequencies over all documents give IDF weights.
    3. The ``anchors`` rarest words of each template's key phrase (``min_anchors`` at least), however many documents
       hold them, look up the template postings; postings agree where position in text less position in template is
       the same. An alignment needs ``min_anchors`` different places (all where the key phrase is shorter) and the
       key phrase in full at its place, so that no alignment is lost to the choice of anchors; its score is the
       share of template words that stand where the template has them, and from ``min_score`` its label is added.
    4. Base phrases count wherever their words stand consecutively; a base label scores 0.5 at least.

    All of a document's work stays in its own row, so no key can be hot; the vocabulary bounds what reaches
    the driver. Null or empty texts: 0 words, null first and last word, empty labels, score 0. Repeated rows give repeated
    results; an empty table an empty one; long texts are scanned whole; extra columns are ignored. ``templates``: label, words and key phrase, which is
    a part of the words; lower-case words as in TEMPLATES."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()} | {w for p in BASE for w in p.split()})
    hits = table(license_hits(docs, vocabulary, id_col, text_col), "license-hits")
    totals = hits.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).collect()  # at most one row per vocabulary word
    n = hits.count()
    idf = {w: math.log((n + 1) / 1) for w in vocabulary} | {r.w: math.log((n + 1) / (r.df + 1)) for r in totals}
    keys = [_key_at(text.split(), key.split()) for _, text, key in templates]
    postings: dict[str, list[tuple[int, int, int]]] = {}  # word -> template, place, places that must agree
    for k, (_, text, _) in enumerate(templates):
        body = text.split()
        rarest = sorted(keys[k], key=lambda p: (-idf[body[p]], body[p], p))[: max(anchors, min_anchors)]
        for p in rarest:
            postings.setdefault(body[p], []).append((k, p, min(min_anchors, len(rarest))))
    lookup = "map(" + ", ".join(f"'{w}', array({', '.join(f'named_struct({chr(39)}k{chr(39)}, {k}, {chr(39)}p{chr(39)}, {p}, {chr(39)}m{chr(39)}, {m})' for k, p, m in found)})" for w, found in postings.items()) + ")"

    def places(phrase: str, array: str = "phrase_hits") -> str:
        words = phrase.split()
        test = " and ".join(f"get({array}, i + {j}).w = '{w}'" + (f" and get({array}, i + {j}).p = get({array}, i).p + {j}" if j else "") for j, w in enumerate(words))
        return f"transform(filter(if(size({array}) = 0, array(), sequence(0, size({array}) - 1)), i -> {test}), i -> get({array}, i).p)"

    # the few hits that matter for phrases and for anchors; both arrays are short in most documents
    base_words = sorted({w for p in BASE for w in p.split()})
    df = hits.withColumn("phrase_hits", F.expr(f"filter(hits, h -> h.w in ({_text_literal(base_words)}))"))
    # anchors with their index among all hits: an alignment's hits lie at most its length away from there
    df = df.withColumn("rare_hits", F.expr(f"filter(transform(hits, (h, i) -> named_struct('w', h.w, 'p', h.p, 'i', i)), h -> h.w in ({_text_literal(postings)}))"))
    for k, phrase in enumerate(BASE):
        df = df.withColumn(f"b{k}", F.expr(places(phrase)))
    df = df.withColumn("starts", F.concat(*[F.col(f"b{k}") for k in range(len(BASE))]))
    df = df.withColumn("base", F.array_distinct(F.expr("filter(array(" + ", ".join(f"if(size(b{k}) > 0, '{label}', null)" for k, label in enumerate(BASE.values())) + "), x -> x is not null)")))
    df = df.withColumn("aligned", F.expr(f"array_sort(flatten(transform(rare_hits, h -> transform(element_at({lookup}, h.w), q -> named_struct('k', q.k, 'o', h.p - q.p, 'p', q.p, 'm', q.m, 'i', h.i)))))"))
    # alignments with enough different anchor places: sorted, those of one alignment are neighbours; the first stands for them
    same = "get(aligned, {0}).k = a.k and get(aligned, {0}).o = a.o"
    df = df.withColumn("tries", F.expr(f"filter(aligned, (a, i) -> {same.format('i + a.m - 1')} and not coalesce({same.format('i - 1')}, false))"))
    cases = []
    for k, (label, text, key) in enumerate(templates):
        body = text.split()
        at = keys[k].start
        near = f"slice(hits, greatest(1, t.i + 2 - {len(body)}), {2 * len(body)})"
        whole = "array(" + _text_literal(body) + ")"
        matched = f"size(filter({near}, h -> h.p >= t.o and h.p < t.o + {len(body)} and element_at({whole}, h.p - t.o + 1) = h.w)) / {len(body)}D"
        keyed = f"size(filter({near}, h -> h.p >= t.o + {at} and h.p < t.o + {at + len(key.split())} and element_at({whole}, greatest(1, least({len(body)}, h.p - t.o + 1))) = h.w)) = {len(key.split())}"
        matched = matched.replace("h.p - t.o + 1", f"greatest(1, least({len(body)}, h.p - t.o + 1))")
        cases.append(f"when t.k = {k} then named_struct('l', '{label}', 's', if({keyed}, {matched}, 0D))")
    df = df.withColumn("found", F.expr(f"filter(transform(tries, t -> case {' '.join(cases)} end), x -> x.s >= {min_score}D)"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.expr("found.l"))))
    score = F.greatest(F.coalesce(F.array_max(F.expr("found.s")), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return df.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
