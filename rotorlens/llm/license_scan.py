"""Licence scan by a positional rare-token index [native].

The index holds, for each licence template, its words of highest inverse document frequency with
their offsets. A file's occurrences of those words are looked up, every (file position - template
offset) is one vote, weighted by the word's IDF, for a placement of that template, and the best
placement must gather enough of the template's weight. A template counts only if one of its
mandatory key phrases stands in the file. Document frequencies are counted over all documents.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Base labels come from
three phrases of consecutive words and are independent of the templates.

Score: the best verified placement's share of its template's indexed weight; a file with a base
phrase scores at least 0.5; without labels it is 0.

Defined cases: a null or empty text has no words, labels '' and null positions; rows that repeat are
scanned each on its own; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Phrases and labels of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Sentences of well-known public licences and their notices, and phrases without which none is named.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-terms": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-notice": "this work is licensed under the gnu general public license version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "cc": "this work is licensed under a creative commons attribution international license",
    "cc-nc": "licensed under cc by nc 4 0",
}
KEY_PHRASES = {
    "mit": ("any person obtaining a copy of this software",),
    "mit-notice": ("shall be included in all copies or substantial portions",),
    "apache": ("apache license version 2 0", "apache license"),
    "apache-terms": ("distributed on an as is basis",),
    "gpl": ("gnu general public license",),
    "gpl-notice": ("gnu general public license",),
    "gpl-warranty": ("gnu general public license",),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "bsd": ("redistribution and use in source and binary forms",),
    "bsd-names": ("endorse or promote products derived from this software",),
    "mpl": ("mozilla public license",),
    "isc": ("permission to use copy modify",),
    "zlib": ("in no event will the authors be held liable",),
    "unlicense": ("unencumbered software released into the public domain",),
    "boost": ("any person or organization obtaining",),
    "cc": ("creative commons attribution",),
    "cc-nc": ("cc by nc",),
}
LABEL_OF = {"mit-notice": "mit", "apache-terms": "apache", "gpl-notice": "gpl", "gpl-warranty": "gpl", "bsd-names": "bsd"}
RARE_WORDS = 8
MIN_SHARE = 0.6

NOT_WORD_LOWER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def frequencies(docs: DataFrame, templates: dict[str, str], text_col: str) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each word of the templates."""
    every = sorted({w for t in templates.values() for w in t.split()})
    words = F.split(common.ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), NOT_WORD_LOWER)
    held = docs.select(F.array_append(F.array_intersect(words, F.array(*[F.lit(w) for w in every])), F.lit("")).alias("held"))
    # The empty word stands for the document itself.
    counted = held.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()  # the templates' words
    found = {r["w"]: r["n"] for r in counted}
    return found.pop("", 0), found


def rarest(template: str, total: int, df: dict[str, int]) -> list[tuple[str, int, float]]:
    """(word, offset, idf) of every place of the template's RARE_WORDS words of highest IDF, of equal ones the first by name."""
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1.0 for w in template.split()}
    chosen = sorted(idf, key=lambda w: (-idf[w], w))[:RARE_WORDS]
    return [(w, at, idf[w]) for at, w in enumerate(template.split()) if w in chosen]


def _any_of(words: list[str]) -> str:
    """A regular expression for a whole word of the list in any case, branching on the first letter."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(w[1:])
    branches = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))
    edge = WORD_ANY_CASE.rstrip("+")
    return f"(?i)(?<!{edge})(?:{branches})(?!{edge})"


def _starts(words: Column, hits: Column, phrase: str) -> Column:
    """Positions where the phrase's words stand consecutively; its first word is always among the hits."""
    first, *rest = phrase.split()

    def here(hit: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, hit["pos"] + k + 1) == w for k, w in enumerate(rest)], hit["w"] == first)

    return F.transform(F.filter(hits, lambda h: F.coalesce(here(h), F.lit(False))), lambda h: h["pos"])


def occurrences(docs: DataFrame, index: list[tuple], templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row_key, doc_id, n_words, places of base phrases, verified templates and hits (pos, w).

    One pass over the texts; what is kept of each are its index hits. It is stored, which fixes row_key.
    """
    firsts = {p.split()[0] for p in [*BASE, *(p for t in templates for p in KEY_PHRASES[t])]}
    vocabulary = sorted({w for _, w, *_ in index} | firsts)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Most texts have no indexed word: one regular expression tells, and no word array is built.
    words = F.when(F.col("text").rlike(_any_of(vocabulary)), F.filter(F.split(common.ascii_lower(F.col("text")), NOT_WORD_LOWER), lambda w: w != ""))
    seen = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("words", words)
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("w"))), lambda h: h["w"].isin(vocabulary))
    seen = seen.withColumn("hits", hits)
    places = [_starts(F.col("words"), F.col("hits"), phrase) for phrase in BASE]
    verified = [F.when(reduce(lambda a, b: a | b, [F.size(_starts(F.col("words"), F.col("hits"), p)) > 0 for p in KEY_PHRASES[t]]), F.lit(t)) for t in templates]
    seen = seen.select(
        F.monotonically_increasing_id().alias("row_key"),
        "doc_id",
        F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
        *[p.alias(f"place_{label}") for p, label in zip(places, BASE.values())],
        F.array_compact(F.array(*verified)).alias("verified"),
        "hits",
    )
    return common.stored(seen, "licence-hits")


def positional_index(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text_col: str = "text") -> list[tuple]:
    """(template, w, off, idf, whole): as many rows as the templates' rare words have places."""
    total, df = frequencies(docs, templates, text_col)
    out = []
    for name, template in templates.items():
        places = rarest(template, total, df)
        whole = sum(idf for *_, idf in places)
        out += [(name, w, off, idf, whole) for w, off, idf in places]
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per row of docs."""
    rows = positional_index(docs, templates, text_col)
    seen = occurrences(docs, rows, templates, id_col, text_col)
    # Bounded by the templates.
    index = F.broadcast(docs.sparkSession.createDataFrame(rows, "template string, w string, off int, idf double, whole double"))
    # A vote may count a template's place once: an occurrence is one word at one position.
    votes = seen.where(F.size("verified") > 0).select("row_key", "verified", F.explode("hits").alias("h")).join(index, F.col("h.w") == F.col("w"))
    votes = votes.where(F.array_contains("verified", F.col("template"))).groupBy("row_key", "template", (F.col("h.pos") - F.col("off")).alias("placed"))
    placed = votes.agg((F.round(F.sum("idf") / F.first("whole"), 9)).alias("share")).where(F.col("share") >= MIN_SHARE)
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_OF.items() for x in kv]), F.col("template")), F.col("template")) if LABEL_OF else F.col("template")
    found = placed.groupBy("row_key").agg(F.collect_set(label).alias("by_template"), F.max("share").alias("share"))
    base = [f"place_{label}" for label in BASE.values()]
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<int>")) for c in base])
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(c[len("place_") :])) for c in base])))
    joined = seen.join(found, "row_key", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("by_template", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce(F.greatest("share", F.when(F.size(every) > 0, 0.5)), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
