"""Licence scans by a positional rare-token index.

Document frequencies over all documents give each licence word's IDF. A template is indexed by its words of highest
IDF, with their positions. A file looks up all of its words that the index has; each place votes
for the template at the relative position where its word would stand. Where enough votes agree, the template's
mandatory key phrases must stand in the file, word for word at that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ALNUM, words

#: Phrases of the base report and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, notice as words, mandatory key phrases as (first word, words).
TEMPLATES = (
    ("mit", "released under the mit license", ((3, 2),)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ((2, 5), (9, 4))),
    ("apache-2.0", "licensed under the apache license version 2 0", ((3, 5),)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ((6, 6),)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ((6, 6),)),
    ("lgpl-3.0", "this work is licensed under the gnu lesser general public license version 3", ((6, 7),)),
    ("agpl-3.0", "this work is licensed under the gnu affero general public license version 3", ((6, 7),)),
    ("cc-by-4.0", "licensed under cc by 4 0", ((2, 4),)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ((2, 5),)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ((2, 5),)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ((6, 6),)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ((0, 3), (6, 2))),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ((0, 5),)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ((2, 4),)),
)

#: Rarest words by which a template is indexed, and votes that must agree.
INDEXED, VOTES = 4, 2


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """Documents with each licence word, over all documents; as many rows as the templates have words."""
    terms = F.array(*[F.lit(w) for w in vocabulary()])
    got = docs.select(F.explode(F.array_intersect(words(F.col("text"), ALNUM), terms)).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in got}


def indexed(df: dict[str, int]) -> list[tuple[str, int, int]]:
    """Postings (word, template, position): every place of each template's words of highest IDF, the rarest word first."""
    out = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        ws = notice.split()
        rare = sorted(set(ws), key=lambda w: (df.get(w, 0), w))[:INDEXED]
        out += [(w, t, i) for i, w in enumerate(ws) if w in rare]
    return sorted(out, key=lambda p: (df.get(p[0], 0), *p))


def places(ws: Column, size: Column, phrase: list[str]) -> Column:
    """Starts, from 0, where the phrase's words stand in an array of words one after another."""

    def here(i: Column) -> Column:
        out = F.get(ws, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            out = out & (F.get(ws, i + F.lit(k)) == w)
        return out

    starts = F.sequence(F.lit(0), size - len(phrase))
    return F.when((size >= len(phrase)) & F.array_contains(ws, phrase[-1]) & F.array_contains(ws, phrase[0]), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def labelled_start(label: str):
    return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs` plus _n_words, _base (array of (start, label)) and _found (array of (label, start, cover)),
    which replace columns of their names.

    A found notice has `cover`, the share of its template's words that stand at their places. Null text has no words.
    Everything but the count of documents is done row by row, without a shuffle.
    """
    df = document_frequency(docs.select(F.col(text).alias("text")))
    postings = indexed(df)
    terms = list(dict.fromkeys(w for w, _, _ in postings))  # the rarest first
    of_term = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for w2, t, i in postings if w2 == w]) for w in terms])
    notices = F.array(*[F.array(*map(F.lit, notice.split())) for _, notice, _ in TEMPLATES])
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])

    def report(ws: Column) -> Column:
        size = F.size(ws)
        base = F.concat(*[F.transform(places(ws, size, p.split()), labelled_start(label)) for p, label in BASE.items()])
        rare = F.array_intersect(F.array(*map(F.lit, terms)), ws)

        def vote(p: Column) -> Column:
            rows = F.get(of_term, (F.array_position(F.array(*map(F.lit, terms)), p["w"]) - 1).cast("int"))
            return F.transform(rows, lambda r: F.struct(r["t"].alias("t"), (p["i"] - r["i"]).alias("start")))

        def cast(own: Column) -> Column:
            """The votes of the places of a file's own rare words, which are looked up once and come as a variable."""
            at = F.filter(F.transform(ws, lambda w, i: F.when(F.array_contains(own, w), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull())
            return F.when(F.size(own) >= VOTES, F.filter(F.flatten(F.transform(at, vote)), lambda v: v["start"] >= 0)).otherwise(F.array().cast("array<struct<t:int,start:int>>"))

        votes = F.element_at(F.transform(F.array(rare), cast), 1)

        def enough(vs: Column) -> Column:
            """The first of each run of equal votes, in sorted order, that is long enough."""
            long = lambda v, i: (F.get(vs, i + F.lit(VOTES - 1)) == v) & ~F.coalesce(F.get(vs, i - 1) == v, F.lit(False))
            return F.filter(vs, long)

        def verified(v: Column) -> Column:
            out = F.lit(False)
            for t, (_, notice, keys) in enumerate(TEMPLATES):
                same = F.lit(True)
                for first, n in keys:
                    for k in range(first, first + n):
                        same = same & F.coalesce(F.get(ws, v["start"] + F.lit(k)) == notice.split()[k], F.lit(False))
                out = F.when(v["t"] == t, same).otherwise(out)
            return out

        def cover(v: Column) -> Column:
            notice = F.get(notices, v["t"])
            there = F.size(F.filter(F.transform(notice, lambda w, k: F.coalesce(F.get(ws, v["start"] + k) == w, F.lit(False))), lambda x: x))
            return F.struct(F.get(labels, v["t"]).alias("label"), v["start"].cast("long").alias("start"), (there.cast("double") / F.size(notice)).alias("cover"))

        kept = F.transform(F.array(F.sort_array(votes)), lambda vs: F.transform(F.filter(enough(vs), verified), cover))
        return F.struct(size.cast("long").alias("n"), base.alias("base"), F.element_at(kept, 1).alias("found"))

    one = F.element_at(F.transform(F.array(words(F.col(text), ALNUM)), report), 1)
    names = [c for c in docs.columns if c not in ("_n_words", "_base", "_found")]
    r = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), one.alias("r"))
    return r.select(*[F.col("row")[c].alias(c) for c in names], F.col("r.n").alias("_n_words"), F.col("r.base").alias("_base"), F.col("r.found").alias("_found"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    score is 1 where a base phrase stands, else the largest cover of a found notice, else 0. Repeated rows each have
    their result; without words or labels the strings are empty and the places null. Empty in, empty out.
    """
    r = scan(docs.select("doc_id", "text"))
    starts = F.transform("_base", lambda b: b["start"])
    base = F.array_distinct(F.transform("_base", lambda b: b["label"]))
    found = F.array_distinct(F.transform("_found", lambda f: f["label"]))
    return r.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_found", lambda f: f["cover"])), F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same in SQL, row by row over words."""
    notices = ", ".join(f"({t}, '{label}', [{', '.join(repr(w) for w in notice.split())}], [{', '.join(str(k) for first, n in keys for k in range(first, first + n))}])" for t, (label, notice, keys) in enumerate(TEMPLATES))
    base = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in BASE.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS ws FROM documents),
n(t, label, ws, keys) AS (VALUES {notices}),
nw AS (SELECT t, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM n),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM w WHERE w IN (SELECT w FROM nw) GROUP BY w),
rare AS (
  SELECT t, w FROM (SELECT DISTINCT t, nw.w, coalesce(df, 0) AS df FROM nw LEFT JOIN df ON nw.w = df.w)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY df, w) <= {INDEXED}),
post AS (SELECT nw.t, nw.w, nw.i FROM nw JOIN rare ON nw.t = rare.t AND nw.w = rare.w),
votes AS (
  SELECT doc_id, t, w.i - post.i AS start, count(*) AS votes FROM w JOIN post ON w.w = post.w WHERE w.i >= post.i GROUP BY ALL HAVING count(*) >= {VOTES}),
found AS (
  SELECT v.doc_id, n.label, len(list_filter(range(len(n.ws)), lambda k: d.ws[v.start + k + 1] = n.ws[k + 1])) / CAST(len(n.ws) AS DOUBLE) AS cover
  FROM votes v JOIN n USING (t) JOIN d USING (doc_id)
  WHERE len(list_filter(n.keys, lambda k: d.ws[v.start + k + 1] = n.ws[k + 1])) = len(n.keys)),
b(phrase, label) AS (VALUES {base}),
bw AS (SELECT doc_id, i AS start, b.label FROM w JOIN b ON w.w = b.phrase[1] JOIN d USING (doc_id) WHERE d.ws[i + 1 : i + len(b.phrase)] = b.phrase),
ba AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bw GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bw UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id),
co AS (SELECT doc_id, max(cover) AS cover FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN ba USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN co USING (doc_id)
"""
