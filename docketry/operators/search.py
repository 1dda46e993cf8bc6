"""Text search: weighted stems, web-style queries, cover-density ranks, headlines and suggestions.

Documents are analysed once, into an array of (term, positions, weight). A query is parsed on the driver into a tree;
matching it is a built-in expression over that array, so Spark pushes the other filters below it; ranks are computed
for the matching rows alone, and headlines for the rows of a page.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Collection, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import refs
from docketry.functions.stem import STOP, stem, tokens
from docketry.operators import relational as op

# Weights of the fields' classes, of document types, bonuses, and numbers of fragments and words.
CLASS_WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
TYPE_WEIGHT = {"bill": 2.0, "fiscal_note": 1.5, "section": 1.0, "amendment": 0.9, "rcw_section": 0.8}
NUMBER_BONUS, LATEST_BONUS = 5.0, 0.2
FRAGMENTS, FRAGMENT_WORDS = 2, 30
FACET_CAP = 30
TERMS = "array<struct<term:string,at:array<int>,weight:string>>"


def analyse(docs: DataFrame, fields: Mapping[str, str], name: str = "terms", only: Collection[str] | None = None) -> DataFrame:
    """All columns plus the weighted terms of the fields (column by class A to D); positions run on from field to field.

    With `only`, all texts are read but just these terms are listed, which is what a scan for one query needs. A batch's
    terms are flat Arrow arrays, so that Python holds four bytes for each place and no object for each document.
    """
    order = sorted(fields.items(), key=lambda kv: kv[1])
    kept = None if only is None else frozenset(only)
    shape = [pa.field("term", pa.string()), pa.field("at", pa.list_(pa.int32())), pa.field("weight", pa.string())]

    @F.arrow_udf(TERMS)
    def terms(*parts: pa.Array) -> pa.Array:
        names, classes, places, ends, offsets = [], [], array("i"), array("i", [0]), array("i", [0])
        for texts in zip(*parts, strict=True):
            base = 0
            for (_, cls), value in zip(order, texts, strict=True):
                text = value.as_py()
                found: dict[str, list[int]] = {}
                for term, at in tokens(text, kept):
                    found.setdefault(term, []).append(base + at)
                for term, at in found.items():
                    names.append(term)
                    classes.append(cls)
                    places.extend(at)
                    ends.append(len(places))
                base += (len((text or "").split()) if len(order) > 1 else 0) + 1
            offsets.append(len(names))
        number = lambda values: pa.array(np.frombuffer(values, dtype=np.int32) if values else [], pa.int32())
        own = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.ListArray.from_arrays(number(ends), number(places)), pa.array(classes, pa.string())], fields=shape)
        return pa.ListArray.from_arrays(number(offsets), own)

    return docs.withColumn(name, terms(*[F.col(c).cast("string") for c, _ in order]))


def postings(docs: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """(term, key, at, weight), the inverted index; write it partitioned by a hash of the term."""
    return docs.select(key, F.explode(terms).alias("t")).select("t.term", key, "t.at", "t.weight")


def parse_query(text: str) -> tuple | None:
    """Tree of ("and" | "or", parts), ("not", part), ("term", stem) and ("phrase", [(stem, offset)]); None if nothing is asked."""
    groups: list[list[tuple]] = [[]]
    for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', text):
        minus, quoted, word = m.groups()
        if word and word.lower() == "or" and not minus:
            groups.append([])
            continue
        found = tokens(quoted if quoted is not None else word)
        if not found:
            continue
        node = ("term", found[0][0]) if len(found) == 1 else ("phrase", [(t, at - found[0][1]) for t, at in found])
        groups[-1].append(("not", node) if minus else node)
    some = [g[0] if len(g) == 1 else ("and", g) for g in groups if g]
    return None if not some else some[0] if len(some) == 1 else ("or", some)


def with_synonyms(text: str, groups: Sequence[Sequence[str]]) -> list[str]:
    """The query, and its forms with the first mention of a group's member replaced by another."""
    low, out = text.lower(), [text]
    for group in groups:
        own = next((g for g in group if g.lower() in low), None)
        if own:
            at = low.index(own.lower())
            out += [text[:at] + g + text[at + len(own) :] for g in group if g != own]
    return list(dict.fromkeys(out))


def any_of(queries: Sequence[str]) -> tuple | None:
    trees = [t for t in map(parse_query, queries) if t]
    return None if not trees else trees[0] if len(trees) == 1 else ("or", trees)


def matches(tree: tuple, terms: Column) -> Column:
    """Whether an analysed document fulfils the tree."""
    kind, arg = tree
    if kind == "term":
        return F.exists(terms, lambda t: t["term"] == arg)
    if kind == "phrase":
        places = lambda term: F.flatten(F.transform(F.filter(terms, lambda t: t["term"] == term), lambda t: t["at"]))
        return F.exists(places(arg[0][0]), lambda p: _all(F.array_contains(places(term), p + offset) for term, offset in arg[1:]))
    if kind == "not":
        return ~matches(arg, terms)
    parts = [matches(p, terms) for p in arg]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if kind == "and" else (out | p)
    return out


def _all(columns) -> Column:
    return op.all_of(list(columns))


def positive_terms(tree: tuple) -> list[str]:
    kind, arg = tree
    if kind == "term":
        return [arg]
    if kind == "phrase":
        return [t for t, _ in arg]
    return [] if kind == "not" else list(dict.fromkeys(t for p in arg for t in positive_terms(p)))


def all_terms(tree: tuple) -> list[str]:
    """Every term of a tree, those that mustn't stand there too."""
    kind, arg = tree
    if kind == "term":
        return [arg]
    if kind == "phrase":
        return [t for t, _ in arg]
    return all_terms(arg) if kind == "not" else list(dict.fromkeys(t for p in arg for t in all_terms(p)))


def cover_density(terms: Sequence[Mapping], wanted: Sequence[str]) -> float:
    """Sum over the shortest stretches that hold all wanted terms, shorter ones counting more; r / (r + 1).

    A stretch counts the harmonic mean of its terms' weights, over one more than the words in it that aren't wanted.
    """
    places = sorted((at, t["term"], CLASS_WEIGHT[t["weight"]]) for t in terms for at in t["at"] if t["term"] in wanted)
    there = {t for _, t, _ in places}
    total, first, count = 0.0, 0, dict.fromkeys(there, 0)
    for last, (_, term, _) in enumerate(places):
        count[term] += 1
        if not all(count.values()):
            continue
        while count[places[first][1]] > 1:
            count[places[first][1]] -= 1
            first += 1
        inside = places[first : last + 1]
        extra = places[last][0] - places[first][0] - (len(inside) - 1)
        total += len(inside) / sum(1 / w for _, _, w in inside) / (1 + max(0, extra))
        count[places[first][1]] -= 1
        first += 1
    return total / (total + 1)


def ranked(docs: DataFrame, tree: tuple, number_forms: str | None = None, query: str | None = None, doc_type: str | None = None, latest: str | None = None, terms: str = "terms") -> DataFrame:
    """Matching documents plus `rank`: cover density by the type's weight, plus bonuses for a number form and the latest version."""
    wanted = positive_terms(tree)

    @F.pandas_udf("double")
    def density(values: pd.Series) -> pd.Series:
        return values.map(lambda ts: cover_density(list(ts), wanted))

    hit = matches(tree, F.col(terms))
    exact = F.array_contains(F.transform(number_forms, F.lower), query.strip().lower()) if number_forms and query else F.lit(False)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv]), F.col(doc_type)), F.lit(1.0)) if doc_type else F.lit(1.0)
    found = docs.where(hit | F.coalesce(exact, F.lit(False)))
    bonus = F.when(exact, NUMBER_BONUS).otherwise(0.0) + (F.when(F.col(latest), LATEST_BONUS).otherwise(0.0) if latest else F.lit(0.0))
    return found.withColumn("rank", density(terms) * weight + bonus)


def search(docs: DataFrame, text: str, filters: Column, roles: Sequence[str], user: str, group: Column, key: str, page_size: int = 20, offset: int = 0, facet_columns: Mapping[str, str] | None = None, synonyms: Sequence[Sequence[str]] = (), **rank_options) -> dict[str, DataFrame]:
    """Page, total and facets of a search. Permission and filters come first; facets count matches, the total groups."""
    seen = docs.where(op.visible_to(roles, user)).where(filters)
    tree = any_of(with_synonyms(text, synonyms))
    matched = ranked(seen, tree, query=text, **rank_options) if tree else seen.withColumn("rank", F.lit(0.0))
    best = op.collapse(matched, [group], [F.col("rank").desc(), F.col(key)])
    return {
        "page": op.page(best, [F.col("rank").desc(), F.col(key)], page_size, offset),
        "total": matched.agg(F.count_distinct(group).alias("total")),
        "facets": op.facets(matched, facet_columns or {}, top={name: FACET_CAP for name in facet_columns or {}}) if facet_columns else None,
        "inner_hits": op.inner_hits(matched, [group], [F.col("rank").desc(), F.col(key)], 2),
    }


def headline(text: str, wanted: Sequence[str], fragments: int = FRAGMENTS, words: int = FRAGMENT_WORDS) -> str:
    """Stretches of the text with most wanted stems, these in <mark>, joined by an ellipsis."""
    parts = (text or "").split()
    hit = [stem(re.sub(r"\W", "", p.lower())) in wanted and p.lower() not in STOP for p in parts]
    taken: list[tuple[int, int]] = []
    for _ in range(fragments):
        free = [i for i in range(len(parts)) if hit[i] and not any(a <= i < b for a, b in taken)]
        if not free:
            break
        start = max(free, key=lambda i: (sum(hit[i : i + words]), -i))
        taken.append((start, min(len(parts), start + words)))
    show = lambda i: f"<mark>{parts[i]}</mark>" if hit[i] else parts[i]
    return " ... ".join(" ".join(show(i) for i in range(a, b)) for a, b in sorted(taken)) or " ".join(parts[:words])


def with_headline(page: DataFrame, tree: tuple, column: str) -> DataFrame:
    """Headlines for the rows of a page."""
    wanted = positive_terms(tree)

    @F.pandas_udf("string")
    def marked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: headline(t, wanted))

    return page.withColumn("headline", marked(column))


def trigrams(text: Column) -> Column:
    """Distinct three-letter strings of the words, each padded by two blanks before and one after."""
    word = F.concat(F.lit("  "), F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "   ")), F.lit(" "))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substr(word, i, F.lit(3)))
    return F.array_distinct(F.filter(every, lambda g: (F.length(g) == 3) & (F.substr(g, F.lit(2), F.lit(2)) != "  ")))


def suggest(docs: DataFrame, text: str, title: str, forms: str, size: int = 10, least: float = 0.3) -> DataFrame:
    """Completions: a number form that begins with the text scores 2, else the similarity of trigrams where it reaches `least`."""
    mine = trigrams(F.lit(text))
    near = op.jaccard(trigrams(F.col(title)), mine)
    begins = F.exists(forms, lambda x: F.startswith(F.lower(x), F.lit(text.lower())))
    scored = docs.withColumn("score", F.when(begins, F.lit(2.0)).otherwise(near)).where(F.col("score") > least)
    return scored.orderBy(F.col("score").desc(), title).limit(size)


def number_forms(bill_type: str, number: int, labels: Sequence[str] = ()) -> list[str]:
    """Spellings under which a bill's number is looked for."""
    return list(dict.fromkeys([f"{bill_type} {number}", f"{bill_type}{number}", str(number), *labels, *(x.replace(" ", "") for x in labels)]))


#: Most amendments and notes that are listed beside a bill.
RELATED = {"amendment": 20, "note": 10}


def asked(text: str, biennium: str) -> dict:
    """What a search asks for: the reference at its start with its address, the text to search for and the filters.

    A bill is a direct hit, and a filter where text follows it; a statute is a filter of its level; a session law is
    searched for by its name. `search` tells whether text or filters are left to search by.
    """
    ref, rest = refs.parse(text, biennium)
    out = {"ref": ref, "url": refs.url_for(ref) if ref else None, "text": rest if ref else text.strip(), "filters": {}}
    match ref and ref["kind"]:
        case "bill" if out["text"]:
            out["filters"] = {"bill_key": refs.bill_key(ref["biennium"], ref["type"], ref["number"])}
        case "rcw":
            level = "section" if "section" in ref else "chapter" if "chapter" in ref else "title"
            out["filters"] = {{"section": "rcw_cites", "chapter": "rcw_chapters", "title": "rcw_titles"}[level]: ref[level]}
        case "session_law":
            out["text"] = f"Chapter {ref['chapter']}, {ref['year']} Laws"
    return out | {"search": bool(out["text"] or out["filters"]) or ref is None}


def most_specific(cites: DataFrame, key: str, cite: str) -> DataFrame:
    """Citations of each key without those that are a title or chapter of another one of it."""
    parts = F.split(cite, "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    broader = cites.where(F.size(parts) > 1).select(key, F.explode(above).alias(cite)).distinct()
    return cites.join(broader, [key, cite], "left_anti")


def related(bills: DataFrame, amendments: DataFrame, notes: DataFrame, statutes: DataFrame) -> DataFrame:
    """(bill_key, kind, id, place) of what stands beside each bill: its latest amendments and notes, its companion, and
    the statutes that it touches, the most specific alone."""

    def latest(rows: DataFrame, kind: str) -> DataFrame:
        best = op.collapse(rows.select("bill_key", F.col("id").cast("string").alias("id"), "date"), ["bill_key"], [F.col("date").desc_nulls_last(), F.col("id")], RELATED[kind], "place")
        return best.select("bill_key", F.lit(kind).alias("kind"), "id", "place")

    parts = [
        latest(amendments, "amendment"),
        latest(notes, "note"),
        bills.where("companion IS NOT NULL").select("bill_key", F.lit("companion").alias("kind"), F.col("companion").alias("id"), F.lit(1).alias("place")),
        op.running_occurrence(most_specific(statutes.select("bill_key", "cite").distinct(), "bill_key", "cite"), ["bill_key"], [op.dotted_key(F.col("cite")), F.col("cite")], "place").select("bill_key", F.lit("statute").alias("kind"), F.col("cite").alias("id"), "place"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def reindexed(index: DataFrame, events: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """An index in which the documents of all bills that events name are those of `rebuilt`, or none."""
    named = events.select("bill_key").where("bill_key IS NOT NULL").distinct()
    return index.join(named, "bill_key", "left_anti").unionByName(rebuilt.join(named, "bill_key", "left_semi"), allowMissingColumns=True)
