"""Search over an inverted index: postings dealt out by term, ranks with early stop, fuzzy terms, fields, completion.

`build` makes the tables from documents, `save` writes them with postings and prefixes in folders by a hash of the
term, so that a query reads the folders of its own terms and, by Parquet's statistics, little beside them. All
searches are joins of the query's terms with these tables; the documents themselves are only read for a page.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.analysis import shingles, stems, token_graph, words_column, words_of
from docketry.operators import relational as op
from docketry.operators.search import CLASS_WEIGHT, all_terms, cover_density, matches, positive_terms

#: Folders of a table that is dealt out by term, and rows of a table that is broadcast, as they were counted.
BUCKETS, BROADCAST_ROWS = 64, 1 << 16
# Boosts of the short and the long fields, of phrases in short fields, of types, of the latest version and of recent
# action; letters from which one and two edits are allowed, letters at the start that must agree, and slack within a phrase.
SHORT = {"bill_number": 5.0, "bill_number_forms": 5.0, "title": 3.0, "heading": 2.0, "sponsor_names": 2.0, "name": 1.0, "caption": 1.0}
LONG = {"added_text": 1.5, "text": 1.0, "body": 1.0, "description": 1.0, "history_text": 0.5, "last_action": 0.5}
PHRASE, PHRASES, SLOP = 2.0, {"title": 3.0, "heading": 2.0}, 2
LATEST, RECENT, RECENT_DAYS = 1.5, 1.2, 30
EDITS, FIXED_LETTERS = (4, 7), 2
#: Digits to which ranks differ; equal ones go by key.
DIGITS = 9
#: How fast repeated terms and long fields lose weight.
K1, B = 1.2, 0.75


def bucket(term: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def build(docs: DataFrame, key: str, fields: Sequence[str], stemmed: bool = True) -> dict[str, DataFrame]:
    """The index's tables over the named text columns:

    * postings (term, key, field, at, n): where a term stands in a field, and the field's number of words;
    * terms (term, field, df) and fields (field, docs, mean): how many documents have a term, and the fields' mean lengths;
    * lengths (key, field, n): the lengths themselves;
    * stems (term, stem): what the words of a query are looked up as.

    Null fields have no words, and documents without words aren't in the index. A null key is a key like any other.
    The keys are counted when the tables are built: only documents of keys that repeat are dealt out, all others become
    postings where they are read.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words_column(F.col(f).cast("string")).alias("words")) for f in fields]))
    rows_of = lambda d: d.select(F.col(key).alias("key"), each.alias("f")).select("key", "f.field", "f.words").where(F.size("words") > 0)
    rows = rows_of(docs)
    again = docs.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again")
    if n := again.count():
        side, same = _side(again, n), F.col(key).eqNullSafe(F.col("_again"))
        several = rows_of(docs.join(side, same, "left_semi")).groupBy("key", "field").agg(F.collect_list("words").alias("all"))
        postings = _placed(rows_of(docs.join(side, same, "left_anti")).select("key", "field", F.array("words").alias("all")).unionByName(several))
    else:
        postings = _placed(rows.select("key", "field", F.array("words").alias("all")))
    dictionary = stems(rows.select(F.explode("words").alias("term"))) if stemmed else None
    if stemmed:
        places = F.array_sort(F.flatten(F.collect_list("at")))
        postings = postings.join(dictionary, "term").groupBy(F.col("stem").alias("term"), "key", "field").agg(places.alias("at"), F.first("n").alias("n"))
    lengths = rows.select("key", "field", F.size("words").alias("n"))
    return {"postings": postings, "terms": terms_of(postings), "fields": fields_of(lengths), "lengths": lengths, "stems": dictionary if stemmed else own_stems(postings)}


def _side(df: DataFrame, rows: int | None) -> DataFrame:
    """The small side of a join: of few rows, counted, a broadcast, so that the large one isn't dealt out; of many never."""
    return df if rows is None else F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _placed(rows: DataFrame) -> DataFrame:
    """(term, key, field, at, n) of (key, field, all): the lists of words of a key's rows, which count as one document. A
    field's words are sorted and cut where the next term begins as one array, so that places don't travel one by one."""
    own = rows.withColumn("n", F.size(F.get("all", F.lit(0))))
    own = own.withColumn("s", F.array_sort(F.flatten(F.transform("all", lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("term"), i.alias("place"))))))).drop("all")
    term = lambda i: F.get(F.col("s"), i)["term"]
    own = own.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (term(i) != term(i - 1)))).withColumn("places", F.transform("s", lambda x: x["place"]))
    cut = F.transform("begins", lambda b, i: F.struct(term(b).alias("term"), F.slice(F.col("places"), b + 1, F.coalesce(F.get(F.col("begins"), i + 1), F.size("s")) - b).alias("at")))
    return own.select("key", "field", "n", F.explode(cut).alias("t")).select("t.term", "key", "field", "t.at", "n")


def terms_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))


def fields_of(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))


def own_stems(postings: DataFrame) -> DataFrame:
    """Stems of an index without stems: each term is its own."""
    return postings.select("term", F.col("term").alias("stem")).distinct()


def deletions(terms: DataFrame, most: int = 2, letters: int = FIXED_LETTERS) -> DataFrame:
    """(variant, term): each term with up to `most` of its letters left out, the first `letters` never.

    Two words within so many edits share a variant, so fuzzy look-ups are a join on it. Words that are too short for
    fewer edits get no variants of more.
    """
    allowed = F.when(F.length("term") >= EDITS[1], 2).when(F.length("term") >= EDITS[0] - 1, 1).otherwise(0)
    drop = lambda w: F.transform(F.sequence(F.lit(letters + 1), F.greatest(F.length(w), F.lit(letters + 1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    own = terms.select("term").distinct().withColumn("_allowed", F.least(F.lit(most), allowed + 1 if most > 1 else allowed))
    variants = F.array(F.col("term"))
    layers = [variants]
    for _ in range(most):
        layers.append(F.array_distinct(F.flatten(F.transform(layers[-1], drop))))
    every = F.concat(layers[0], *[F.when(F.col("_allowed") >= i, layer).otherwise(F.array().cast("array<string>")) for i, layer in enumerate(layers[1:], 1)])
    return own.select(F.explode(F.array_distinct(every)).alias("variant"), "term")


def edits(a: str, b: str) -> int:
    """Letters to put in, leave out, change or swap to get from one word to the other; swapped letters may have moved apart."""
    most = len(a) + len(b)
    cost = {(-1, j): most for j in range(-1, len(b) + 1)} | {(i, -1): most for i in range(len(a) + 1)}
    cost |= {(0, j): j for j in range(len(b) + 1)} | {(i, 0): i for i in range(len(a) + 1)}
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        matched = 0
        for j, y in enumerate(b, 1):
            row, column = seen.get(y, 0), matched
            if x == y:
                matched = j
            swapped = cost[row - 1, column - 1] + (i - row - 1) + 1 + (j - column - 1) if row and column else most
            cost[i, j] = min(cost[i - 1, j] + 1, cost[i, j - 1] + 1, cost[i - 1, j - 1] + (x != y), swapped)
        seen[x] = i
    return cost[len(a), len(b)]


def fuzzy(asked: DataFrame, variants: DataFrame) -> DataFrame:
    """(word, term, edits): the dictionary's terms near each asked word: one edit from four letters on, two from seven, the first two letters the same."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    words = asked.select(F.col("word")).distinct()
    own = deletions(words.withColumnRenamed("word", "term"))
    met = own.select("variant", F.col("term").alias("word")).join(variants, "variant").select("word", "term").distinct()
    met = met.where(F.substr("word", F.lit(1), F.lit(FIXED_LETTERS)) == F.substr("term", F.lit(1), F.lit(FIXED_LETTERS)))
    allowed = F.when(F.length("word") >= EDITS[1], 2).when(F.length("word") >= EDITS[0], 1).otherwise(0)
    return met.withColumn("edits", distance("word", "term")).where(F.col("edits") <= allowed)


def save(tables: Mapping[str, DataFrame], path: str, buckets: int = BUCKETS, stemmed: bool = True) -> None:
    """Writes the tables; those with a term, prefix, variant or trigram in folders by its hash and their number, sorted within.

    Numbers by term and field are counted from postings and lengths as they were written, if these are among the tables,
    so that the texts aren't analysed for them again; without stems the terms are listed so too. Postings without stems
    aren't dealt out: each task sorts those of the documents that it reads and writes a file to each folder, so that
    beside the index itself only what a task sorts takes disk.
    """
    made = {"terms": ("postings", terms_of), "fields": ("lengths", fields_of)} | ({} if stemmed else {"stems": ("postings", own_stems)})
    for name, df in sorted(tables.items(), key=lambda kv: kv[0] in made):
        if name in made and made[name][0] in tables:
            df = made[name][1](df.sparkSession.read.parquet(f"{path}/{made[name][0]}"))
        by = next((c for c in ("term", "prefix", "variant", "gram") if c in df.columns), None)
        if by and name != "stems":
            dealt = df.withColumns({"buckets": F.lit(buckets), "bucket": bucket(F.col(by), F.lit(buckets))})
            if name != "postings" or stemmed:
                # Where a frequent term makes a folder too much for one task, Spark deals it out to several.
                dealt = dealt.hint("rebalance", F.col("bucket"))
            dealt.sortWithinPartitions("bucket", by).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def of_terms(table: DataFrame, terms: Sequence[str], by: str = "term") -> DataFrame:
    """Rows of a saved table for these few terms: folders and row groups of others aren't read."""
    found = table.where(F.col(by).isin(list(terms)))
    if "buckets" not in table.columns:
        return found
    own = reduce(Column.__or__, [F.col("bucket") == bucket(F.lit(t), F.col("buckets")) for t in terms], F.lit(False))
    return found.where(own).drop("bucket", "buckets")


def asked_tree(text: str, stem_of: Mapping[str, str], groups: Sequence[Sequence[str]] | None = None) -> tuple | None:
    """A query as a tree: all positions of its token graph, each by any of its forms, a form of several words as a phrase."""
    graph = token_graph(words_of(text), groups) if groups is not None else token_graph(words_of(text))
    word = lambda w: stem_of.get(w, w)
    node = lambda form: ("term", word(form[0])) if len(form) == 1 else ("phrase", [(word(w), i) for i, w in enumerate(form)])
    slots = [node(forms[0]) if len(forms) == 1 else ("or", [node(f) for f in forms]) for forms in graph]
    return None if not slots else slots[0] if len(slots) == 1 else ("and", slots)


def search_terms(tables: Mapping[str, DataFrame], tree: tuple, classes: Mapping[str, str], types: DataFrame | None = None, k: int = 20) -> DataFrame:
    """The `k` best (key, rank) of a tree of terms by cover density, as a ranked search of the documents would find them.

    Only the postings of the tree's terms are read; a document's are put together and matched there. A shortest
    stretch holds a place of the document's rarest term, and a place lies in no more of them than there are terms, so
    a rank can't exceed what so many stretches of the best weight would give.
    The documents of the largest bounds are ranked first, and of the others only those whose bound exceeds the k-th
    best rank found. `types` has (key, weight, bonus), for a factor and an addend of each key.
    """
    wanted = positive_terms(tree)
    rows = of_terms(tables["postings"], list(dict.fromkeys(all_terms(tree))))
    weight = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    # Fields run on from one another, as in the analysed document: a field begins where those of better classes end.
    own = rows.groupBy("key").agg(F.collect_list(F.struct("term", F.transform("at", lambda p: p.cast("int")).alias("at"), F.col("field"))).alias("found"))
    offsets = _offsets(tables, own, classes)
    own = own.join(offsets, "key") if offsets is not None else own.withColumn("begins", F.create_map().cast("map<string,int>"))
    terms = F.transform("found", lambda t: F.struct(t["term"].alias("term"), F.transform(t["at"], lambda p: p + F.coalesce(F.try_element_at(F.col("begins"), t["field"]), F.lit(0))).alias("at"), F.element_at(weight, t["field"]).alias("weight")))
    own = own.select("key", terms.alias("terms")).where(matches(tree, F.col("terms")))
    number = lambda w: F.aggregate(F.filter("terms", lambda t: t["term"] == w), F.lit(0), lambda s, t: s + F.size(t["at"]))
    counts = F.filter(F.array(*map(number, wanted)), lambda c: c > 0) if wanted else F.array(F.lit(0))
    heaviest = F.array_max(F.transform(F.filter("terms", lambda t: t["term"].isin(wanted)), lambda t: F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_WEIGHT.items() for x in kv]), t["weight"])))
    most = F.coalesce(F.array_min(counts) * F.size(counts) * heaviest, F.lit(0.0))
    own = own.withColumn("_most", most / (most + 1))
    own = own.join(types, "key", "left") if types is not None else own.withColumns({"weight": F.lit(1.0), "bonus": F.lit(0.0)})
    own = own.withColumn("_bound", F.col("_most") * F.coalesce("weight", F.lit(1.0)) + F.coalesce("bonus", F.lit(0.0)))

    def density(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rank = [round(cover_density(list(ts), wanted) * w + b, DIGITS) for ts, w, b in zip(rows["terms"], rows["weight"], rows["bonus"], strict=True)]
            yield pd.DataFrame({"key": rows["key"], "rank": pd.Series(rank, dtype=float)})

    kind = own.schema["key"].dataType.simpleString()
    exact = lambda df: df.select("key", "terms", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("bonus", F.lit(0.0)).alias("bonus")).mapInPandas(density, f"key {kind}, rank double")
    order = [F.col("_bound").desc(), F.col("key")]
    first = exact(own.orderBy(*order).limit(min(4 * k, 1 << 20))).orderBy(F.col("rank").desc(), "key").limit(k).collect()
    if len(first) < k:
        return exact(own).orderBy(F.col("rank").desc(), "key").limit(k)
    return exact(own.where(F.col("_bound") >= first[-1]["rank"] - 10.0**-DIGITS)).orderBy(F.col("rank").desc(), "key").limit(k)


def _offsets(tables: Mapping[str, DataFrame], own: DataFrame, classes: Mapping[str, str]) -> DataFrame | None:
    """(key, begins): where each field of a document begins, if the index has its lengths by document."""
    if "lengths" not in tables:
        return None
    order = sorted(classes, key=lambda f: classes[f])
    lengths = tables["lengths"].join(own.select("key"), "key", "left_semi").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "n"))).alias("sizes"))
    size = lambda f: F.coalesce(F.try_element_at("sizes", F.lit(f)), F.lit(0)) + 1
    begins, at = [], F.lit(0)
    for f in order:
        begins += [F.lit(f), at.cast("int")]
        at = at + size(f)
    return lengths.select("key", F.create_map(*begins).alias("begins"))


def best_fields(tables: Mapping[str, DataFrame], queries: DataFrame, boosts: Mapping[str, float], fuzziness: DataFrame | None = None) -> DataFrame:
    """(qid, key, score) of every document of which one field has all words of a query (qid, words): the best such field's.

    A word's score is its rarity in the field, damped by repetition and by the field's length; `fuzziness` is (word,
    term, edits), and of the terms near a word the best one in a field counts, less one third for each edit.
    """
    asked = queries.select("qid", F.explode(F.array_distinct("words")).alias("word"))
    n = asked.count()
    near = asked.select("word").distinct().select("word", F.col("word").alias("term"), F.lit(0).alias("edits")) if fuzziness is None else fuzziness
    asked = asked.join(_stems_of(tables, asked, n), "word", "left").withColumn("word", F.coalesce("stem", "word")).drop("stem").distinct()
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    # What is asked meets the terms' numbers first, so that it alone travels, not the postings; how many terms are near isn't known.
    few = n * len(boosts) if fuzziness is None else None
    wanted = tables["terms"].where(F.col("field").isin(list(boosts))).join(_side(asked.join(near, "word"), few), "term")
    wanted = wanted.join(F.broadcast(tables["fields"]), "field")  # a row for each field
    places = tables["postings"].where(F.col("field").isin(list(boosts))).select("term", "field", "key", "n", F.size("at").alias("tf"))
    hits = places.join(_side(wanted, few), ["term", "field"])
    rarity = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    own = rarity * (K1 + 1) * tf / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean"))) * (1 - F.col("edits") / 3)
    # Dealt out once, by query and document, for all sums that follow.
    hits = hits.select("qid", "key", "field", "word", own.alias("score")).repartition("qid", "key")
    by_word = hits.groupBy("qid", "key", "field", "word").agg(F.max("score").alias("score"))
    by_field = by_word.groupBy("qid", "key", "field").agg(F.count(F.lit(1)).alias("met"), F.sum("score").alias("score"))
    full = by_field.join(_side(asked.groupBy("qid").agg(F.count(F.lit(1)).alias("needed")), n), "qid").where("met = needed")
    return full.groupBy("qid", "key").agg(F.max(F.col("score") * F.element_at(boost, F.col("field"))).alias("score"))


def _stems_of(tables: Mapping[str, DataFrame], asked: DataFrame, n: int) -> DataFrame:
    """(word, stem) of the asked words, `n` at most, that the index knows."""
    known = tables["stems"].withColumnRenamed("term", "word").join(_side(asked.select("word").distinct(), n), "word", "left_semi")
    return _side(known, n)


def near_phrases(tables: Mapping[str, DataFrame], queries: DataFrame, boosts: Mapping[str, float], slop: int = SLOP) -> DataFrame:
    """(qid, key, score) where all words of a query, two or more, stand in a field in order with at most `slop` others among them.

    Words are chained: each place of the first word is followed by the next word's nearest place behind.
    """
    asked = queries.where(F.size("words") > 1).select("qid", "words", F.posexplode("words").alias("i", "word"))
    n = asked.count()
    asked = asked.join(_stems_of(tables, asked, n), "word", "left").withColumn("term", F.coalesce("stem", "word"))
    hits = tables["postings"].where(F.col("field").isin(list(boosts))).join(_side(asked, n), "term")
    by = hits.groupBy("qid", "key", "field", F.size("words").alias("asked")).agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("all")).where(F.size("all") == F.col("asked"))
    start = F.transform(F.get("all", F.lit(0))["at"], lambda p: F.struct(p.alias("first"), p.alias("last")))

    def follow(chains: Column, word: Column) -> Column:
        behind = lambda c: F.array_min(F.filter(word["at"], lambda p: p > c["last"]))
        return F.filter(F.transform(chains, lambda c: F.struct(c["first"].alias("first"), behind(c).alias("last"))), lambda c: c["last"].isNotNull())

    ends = F.aggregate(F.slice("all", 2, 1 << 20), start, follow)
    slack = F.array_min(F.transform(ends, lambda c: c["last"] - c["first"] - (F.col("asked") - 1)))
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    near = by.withColumn("slack", slack).where(F.col("slack") <= slop)
    return near.groupBy("qid", "key").agg(F.max(F.element_at(boost, F.col("field")) / (1 + F.col("slack"))).alias("score"))


def ranked_fields(tables: Mapping[str, DataFrame], queries: DataFrame, traits: DataFrame | None = None, short: Mapping[str, float] = SHORT, long: Mapping[str, float] = LONG, phrases: Mapping[str, float] = PHRASES, variants: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(qid, key, score, place): the `k` best documents of each query (qid, words) by several fields.

    The best short field, in which words may be misspelled, the best long field, and a phrase in a short one add up;
    one of the first two must match. `traits` is (key, weight, latest, acted_within_days): the latest version and
    recent action add, the type's weight multiplies. Ties go by key.
    """
    near = fuzzy(queries.select(F.explode("words").alias("word")).join(tables["stems"].withColumnRenamed("term", "word"), "word", "left").select(F.coalesce("stem", "word").alias("word")), variants) if variants is not None else None
    parts = [best_fields(tables, queries, short, near), best_fields(tables, queries, long)]
    scores = reduce(DataFrame.unionByName, parts).groupBy("qid", "key").agg(F.sum("score").alias("score"))
    extra = near_phrases(tables, queries, phrases).select("qid", "key", (F.col("score") * PHRASE).alias("more"))
    scores = scores.join(extra, ["qid", "key"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more")
    if traits is not None:
        bonus = F.when(F.col("latest"), LATEST).otherwise(0.0) + F.when(F.col("acted_within_days") <= RECENT_DAYS, RECENT).otherwise(0.0)
        scores = scores.join(traits, "key", "left").select("qid", "key", ((F.col("score") + F.coalesce(bonus, F.lit(0.0))) * F.coalesce("weight", F.lit(1.0))).alias("score"))
    scores = scores.withColumn("score", F.round("score", 6))
    return op.collapse(scores, ["qid"], [F.col("score").desc(), F.col("key")], k, "place")


def completions(docs: DataFrame, key: str, title: str, forms: str, most: int = 12) -> DataFrame:
    """(prefix, key, kind, place): beginnings of the number forms, and of the title's words and shingles by where they begin.

    The rows of a key meet before beginnings are made, and the first of equal ones is told within their sorted array,
    so that no task gathers the beginnings of many keys.
    """
    starts = lambda values, kind: F.flatten(F.transform(values, lambda x, i: F.transform(F.sequence(F.lit(1), F.least(F.length(x), F.lit(most))), lambda n: F.struct(F.substr(x, F.lit(1), n).alias("prefix"), F.lit(kind).alias("kind"), i.alias("place")))))
    every = lambda r: F.concat(starts(F.filter(F.transform(r["forms"], F.lower), lambda x: x != ""), "number"), starts(r["words"], "word"), starts(shingles(r["words"]), "shingle"))
    own = docs.select(F.col(key).alias("key"), F.struct(words_column(F.col(title)).alias("words"), F.col(forms).alias("forms")).alias("r")).where("r.forms IS NOT NULL")
    own = own.groupBy("key").agg(F.collect_list("r").alias("rows")).select("key", F.array_sort(F.flatten(F.transform("rows", every))).alias("c"))
    before = lambda i: F.get(F.col("c"), i - 1)
    fresh = F.filter("c", lambda x, i: (i == 0) | (x["prefix"] != before(i)["prefix"]) | (x["kind"] != before(i)["kind"]))
    return own.select("key", F.explode(fresh).alias("c")).select("c.prefix", "key", "c.kind", "c.place")


def complete(prefixes: DataFrame, text: str, size: int = 10) -> DataFrame:
    """(key, kind, place): what begins as typed. With a digit in it numbers come before titles, else after them; within, earlier words first."""
    typed = " ".join(words_of(text)) if not any(c.isdigit() for c in text) else text.strip().lower()
    number_first = any(c.isdigit() for c in typed)
    found = of_terms(prefixes, [typed[:12]], "prefix")
    order = F.when(F.col("kind") == "number", 0 if number_first else 1).otherwise(1 if number_first else 0)
    best = found.groupBy("key").agg(F.min(F.struct(order.alias("_o"), "place", "kind")).alias("b"))
    return best.orderBy("b._o", "b.place", "key").limit(size).select("key", "b.kind", "b.place")


def grams_of(docs: DataFrame, key: str, title: str) -> DataFrame:
    """(gram, key, n): the trigrams of each title, with how many it has; titles without letters have none."""
    from docketry.operators.search import trigrams

    rows = docs.select(F.col(key).alias("key"), trigrams(F.coalesce(title, F.lit(""))).alias("g")).where(F.size("g") > 0)
    return rows.select("key", F.size("g").alias("n"), F.explode("g").alias("gram"))


def similar_titles(grams: DataFrame, asked: DataFrame, least: float = 0.3) -> DataFrame:
    """(qid, key, score): titles whose trigrams are as similar as `least` to those of a query (qid, text), by counting shared ones.

    Such a pair shares so many trigrams that, in whatever order a title's stand, one of its first ones is shared. They
    stand rarest first, a pair is met at the first trigram that both have, and is compared there as two arrays: only
    pairs that are similar leave a task, and none are counted up.
    """
    from docketry.operators.search import trigrams

    q = asked.select("qid", trigrams(F.col("text")).alias("own")).withColumn("asked", F.size("own"))
    by_gram = q.select("qid", "asked", F.explode("own").alias("gram"))
    often = by_gram.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rows = grams.select("gram", "key", "n").join(often, "gram", "left")
    titles = rows.repartition("key").groupBy("key", "n").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("g"))
    placed = titles.select("key", "n", F.transform("g", lambda x: x["gram"]).alias("grams"), F.posexplode(F.transform("g", lambda x: x["gram"])).alias("place", "gram"))
    needed = F.greatest(F.floor((F.col("asked") + F.col("n")) * (least / (1 + least)) - 1e-9) + 1, F.lit(1))
    met = placed.join(by_gram, "gram").where((F.least("asked", "n") > F.greatest("asked", "n") * F.lit(least)) & (F.col("place") <= F.col("n") - needed))
    both = met.join(q.select("qid", "own"), "qid").withColumn("both", F.array_intersect("grams", "own")).where(F.get("both", F.lit(0)) == F.col("gram"))
    scored = both.withColumn("same", F.size("both")).withColumn("score", F.col("same") / (F.col("asked") + F.col("n") - F.col("same")))
    return scored.where(F.col("score") > least).select("qid", "key", "score")
