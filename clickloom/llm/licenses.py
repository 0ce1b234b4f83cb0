"""License scans: an exact set-similarity join, in DataFrame functions only.

A block is a run of words, over line ends, comment marks and punctuation: as many as a template
has and an eighth more.  A text is labelled with each template of whose tokens a block
contains at least the share ``threshold`` (containment: |block and template| / |template|);
words that stand further apart are no notice.  One pass over the texts stores the places of all
words that any template or base phrase has; everything else reads these.  Template tokens are
ordered by their frequency in the whole corpus, rarest first.  A block that meets the threshold
must have a token of the template's prefix (prefix filter), as many template tokens around it as
are needed (length filter) and, from the token's places in both orders, enough tokens left
(positional filter); what remains is verified block by block.  The templates are a bounded
table, so the join's broadcast side is; no step cuts or caps texts.

Nulls and empty texts have no words and no labels; their score is 0.  Very long texts are
scanned whole.  Repeated rows are scanned each; of equally good blocks the first one is the match,
and equally frequent tokens are in the order of their letters.  Empty tables give empty tables.
Extra columns are ignored; ``keep`` columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What the templates say, and labels of the method's own.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "apache-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z are lower-cased
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # what stands between words, in any case


def low(text: Column) -> Column:
    """A-Z in lower case; letters that would become A-Z or a-z become others.  Word ends stay as they are."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def tokens(template: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall("[a-z0-9]+", template.lower())))


def length(template: str) -> int:
    import re

    return len(re.findall("[a-z0-9]+", template.lower()))


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Tokens of a template of ``size`` that a block must contain."""
    import math

    return max(1, math.ceil(size * threshold - 1e-9))


def width(template: str) -> int:
    """Words of a block."""
    n = length(template)
    return n + max(1, n // 8)


def prefix_index(templates: dict[str, str], freq: dict[str, int], threshold: float = THRESHOLD):
    """[(token, label, place in the template's order, template size, needed, all tokens, words of a block)] of the prefixes."""
    out = []
    for label, t in templates.items():
        own = sorted(tokens(t), key=lambda w: (freq[w], w))
        need = needed(len(own), threshold)
        out += [(w, label, i, len(own), need, own, width(t)) for i, w in enumerate(own[: len(own) - need + 1])]
    return out


def known_words(docs: DataFrame, keep: list[str], vocabulary: list[str], text: str = "text") -> DataFrame:
    """_row, ``keep`` columns, n_words and _known: (token, place) of the vocabulary's words, in order."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.split(low(F.coalesce(F.col(text).cast("string"), F.lit(""))), f"{GAP}+").alias("_w"))
    # a gap at either end leaves an empty word there
    lead, size = (F.get("_w", F.lit(0)) == "").cast("int"), F.size("_w")
    trail = ((size > 1) & (F.get("_w", size - 1) == "")).cast("int")
    known = F.array_compact(F.transform("_w", lambda x, i: F.when(x.isin(vocabulary), F.struct(x.alias("token"), i.alias("place")))))
    rows = rows.select("_row", *keep, (size - lead - trail).cast("long").alias("n_words"), lead.alias("_lead"), known.alias("_known"))
    return rows.select("_row", *keep, "n_words", F.transform("_known", lambda x: F.struct(x["token"].alias("token"), (x["place"] - F.col("_lead")).alias("place"))).alias("_known"))


def places(phrase: str) -> Column:
    """Starts, from 0, of the phrase's words in the text."""
    parts = phrase.split()

    def here(x, j):
        out = x["token"] == parts[0]
        for k, p in enumerate(parts[1:], 1):
            y = F.get("_known", j + k)
            out = out & F.coalesce((y["token"] == p) & (y["place"] == x["place"] + k), F.lit(False))
        return out

    return F.transform(F.filter("_known", here), lambda x: x["place"])


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: dict[str, str] | DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, n_words, n_base, first_word, last_word, base_labels and labels (arrays),
    score, and matches (array of label, word, containment: the first of the best blocks of each label, from
    its first template word), for every row.  ``templates``: label -> text, or a table (label, text) of
    some thousand rows at most, which the driver reads."""
    if isinstance(templates, DataFrame):
        templates = {r.label: r.text for r in templates.select("label", "text").collect()}
    templates = TEMPLATES if templates is None else templates
    keep = [c for c in keep if c not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")]
    vocabulary = sorted({w for t in templates.values() for w in tokens(t)})
    rows = stage(known_words(docs, keep, sorted({*vocabulary, *" ".join(PHRASES).split()}), text), "licenses")
    counts = {r.w: r.n for r in rows.select(F.explode("_known.token").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # the vocabulary at most
    freq = {w: counts.get(w, 0) for w in vocabulary}
    index = prefix_index(templates, freq, threshold)
    order = F.array(*[F.lit(w) for w in sorted(vocabulary, key=lambda w: (freq[w], w))])
    gate, reach = sorted({r[0] for r in index}), max((r[6] for r in index), default=1)
    table = rows.sparkSession.createDataFrame(index, "token string, label string, rank int, size int, need int, own array<string>, width int")
    # each prefix token with the known words that may share a block with it
    around = lambda x, j: F.filter(F.slice("_known", F.greatest(j - reach + 2, F.lit(1)), F.lit(2 * reach - 1)), lambda y: F.abs(y["place"] - x["place"]) < reach)
    marked = F.array_compact(F.transform("_known", lambda x, j: F.when(x["token"].isin(gate), F.struct(x.alias("x"), around(x, j).alias("near")))))
    found = rows.where(F.exists("_known", lambda x: x["token"].isin(gate))).select("_row", F.explode(marked).alias("m")).select("_row", F.col("m.x.token").alias("token"), F.col("m.x.place").alias("place"), "m.near")
    found = found.join(F.broadcast(table), "token").withColumn("near", F.filter("near", lambda y: (F.abs(y["place"] - F.col("place")) < F.col("width"))))
    found = found.withColumn("_block", F.array_intersect(order, F.col("near.token")))
    left = 1 + F.least(F.col("size") - F.col("rank") - 1, F.size("_block") - F.array_position("_block", F.col("token")).cast("int"))
    found = found.where((F.size(F.array_intersect("own", "_block")) >= F.col("need")) & (left >= F.col("need")))
    # a block starts at one of the template's words, at the prefix token or before it
    starts = F.filter("near", lambda y: (y["place"] <= F.col("place")) & F.array_contains("own", y["token"]))
    inside = lambda s: F.transform(F.filter("near", lambda y: (y["place"] >= s["place"]) & (y["place"] < s["place"] + F.col("width"))), lambda y: y["token"])
    blocks = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect("own", inside(s))).alias("shared"), (-s["place"]).alias("word")))
    found = found.withColumn("b", F.array_max(blocks)).where("b.shared >= need")
    best = found.groupBy("_row", "label").agg(F.max(F.struct((F.col("b.shared") / F.col("size")).alias("containment"), F.col("b.word").alias("word"))).alias("b"))
    best = best.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("label", (-F.col("b.word")).alias("word"), F.col("b.containment").alias("containment")))).alias("matches"))
    starts_of = [places(p).alias(f"_p{i}") for i, p in enumerate(PHRASES)]
    out = rows.select("_row", *keep, "n_words", *starts_of).join(best, "_row", "left")
    every = F.concat(*[f"_p{i}" for i in range(len(PHRASES))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, label) for i, label in enumerate(PHRASES.values())])))
    matches = F.coalesce("matches", F.array().cast("array<struct<label:string,word:int,containment:double>>"))
    out = out.select(
        *keep, "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        base.alias("base_labels"), matches.alias("matches"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    score = F.greatest(F.when(F.size("base_labels") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
    return out.withColumn("labels", labels).withColumn("score", score)


def oracle_sql() -> str:
    """The same in DuckDB: every block of every text against every template."""
    phrase = " UNION ALL ".join(
        f"SELECT rn, '{label}' AS label, i - 1 AS p FROM (SELECT rn, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in PHRASES.items()
    )
    rows = ", ".join(f"('{label}', {tokens(t)!r}, {len(tokens(t))}, {needed(len(tokens(t)))}, {width(t)})" for label, t in TEMPLATES.items())
    lowered = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({lowered}, '{WORD}') AS w FROM documents),
places AS ({phrase}),
base AS (SELECT rn, count(*) AS n, min(p) AS lo, max(p) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY rn),
template(label, own, size, need, width) AS (VALUES {rows}),
cand AS (SELECT rn, w, label, own, size, need, width FROM d, template WHERE len(list_intersect(own, w)) >= need),
blocks AS (SELECT rn, label, size, need, len(list_intersect(own, w[i:i + width - 1])) AS n FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM cand) WHERE list_contains(own, w[i])),
found AS (SELECT rn, label, max(n / size) AS c FROM blocks WHERE n >= need GROUP BY rn, label),
every AS (SELECT rn, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rn, label FROM found UNION ALL SELECT rn, label FROM places) GROUP BY rn),
top AS (SELECT rn, max(c) AS c FROM found GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.lo AS BIGINT) AS first_word, CAST(base.hi AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CAST(greatest(CASE WHEN base.n > 0 THEN 1 ELSE 0 END, coalesce(top.c, 0)) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (rn) LEFT JOIN every USING (rn) LEFT JOIN top USING (rn)
"""
