"""The inverted index against scans and plain versions."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.functions import analysis
from docketry.operators import inverted, search

TEXTS = ["Salmon recovery and the salmon tax", "A tax on business & occupation taxes", "The department of revenue's reet: salmon", "Élan vital taxes; taxing salmon habitat recovery near the Skagit river salmon run", None, "", "tax tax tax salmon", "occupational safety in the business of salmon and taxes"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    more = [" ".join(rnd.choice("salmon tax recovery river habitat board fee the of".split()) for _ in range(rnd.randint(3, 40))) for _ in range(60)]
    return spark.createDataFrame([(i, t, (t or "")[:30], "x") for i, t in enumerate(TEXTS + more)], "doc_id long, body string, title string, term string")


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('index')}"
    built = inverted.build(docs, "doc_id", ["title", "body"], stemmed=False)
    inverted.save(built | {"variants": inverted.deletions(built["terms"])}, at, buckets=8)
    return inverted.load(spark, at, *built, "variants")


def test_words_agree_with_the_column(spark):
    texts = ["B&O tax", "The Department’s Élan, o'clock", "Straße ÆON Łódź", "", None, "x-y_z 12.5", "ﬁsh naïve"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(analysis.words_column(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [analysis.words_of(t) for t in texts]
    assert analysis.words_of("B&O Department’s Straße") == ["b", "and", "o", "department", "strasse"]


def test_token_graph_and_tree():
    graph = analysis.token_graph(["the", "department", "of", "revenue", "b", "and", "o", "tax"])
    assert graph[0] == [("the",)] and set(graph[1]) == {("department", "of", "revenue"), ("dor",)} and ("business", "and", "occupation") in graph[2] and graph[3] == [("tax",)]
    tree = inverted.asked_tree("DOR taxes", {"taxes": "tax"})
    assert tree[0] == "and" and tree[1][0][0] == "or" and ("term", "dor") in tree[1][0][1] and tree[1][1] == ("term", "tax")


def test_stems_are_words_of_the_dictionary(spark):
    words = ["tax", "taxes", "taxing", "run", "running", "city", "cities", "make", "making", "bus", "buses", "glass", "news", "string", "quickly", "quick"]
    got = {r["term"]: r["stem"] for r in analysis.stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == dict(zip(words, words, strict=True)) | {"taxes": "tax", "taxing": "tax", "running": "run", "cities": "city", "making": "make", "buses": "bus", "quickly": "quick"}


def test_shingles(spark):
    r = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>").select(analysis.shingles(F.col("w")).alias("s")).collect()
    assert [sorted(x["s"]) for x in r] == [["a b", "a b c", "b c"], [], []]


@pytest.mark.parametrize("text,k", [("salmon tax", 5), ("salmon", 3), ("recovery river habitat", 10), ("salmon unheard", 5), ("tax", 1000), ("the of", 1), ("the of", 2), ("fee the", 1), ("habitat fee of", 2), ("river board", 1), ("salmon tax", 1), ("of fee river the", 1)])
def test_ranks_agree_with_a_scan(docs, tables, text, k):
    """The index finds what ranking every document finds, whichever were left out by their bounds."""
    tree = inverted.asked_tree(text, {})
    scanned = [(r["doc_id"], round(inverted.cover_density(terms, inverted.positive_terms(tree)), inverted.DIGITS)) for r in docs.collect() if (terms := plain_terms(r)) and fits(tree, terms)]
    want = sorted(scanned, key=lambda x: (-x[1], x[0]))[:k]
    got = [(r["key"], r["rank"]) for r in inverted.search_terms(tables, tree, {"title": "A", "body": "D"}, k=k).collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and got == [(i, pytest.approx(x)) for i, x in want]


def plain_terms(r):
    out, base = [], 0
    for field, cls in (("title", "A"), ("body", "D")):
        words = analysis.words_of(r[field])
        out += [{"term": w, "at": [base + i for i, x in enumerate(words) if x == w], "weight": cls} for w in dict.fromkeys(words)]
        base += len(words) + 1
    return out


def fits(tree, terms):
    kind, arg = tree
    return any(t["term"] == arg for t in terms) if kind == "term" else all(fits(p, terms) for p in arg)


def test_phrases_and_negation(docs, tables):
    tree = ("and", [("phrase", [("salmon", 0), ("tax", 1)]), ("not", ("term", "river"))])
    got = {r["key"] for r in inverted.search_terms(tables, tree, {"title": "A", "body": "D"}, k=1000).collect()}
    words = {r["doc_id"]: [analysis.words_of(r["title"]), analysis.words_of(r["body"])] for r in docs.collect()}
    assert got == {i for i, fields in words.items() if any(p == ("salmon", "tax") for f in fields for p in itertools.pairwise(f)) and not any("river" in f for f in fields)}


def test_only_folders_of_the_terms_are_read(tables):
    plan = inverted.of_terms(tables["postings"], ["salmon"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("a,b,n", [("abc", "abc", 0), ("abcd", "abdc", 1), ("salmon", "slamon", 1), ("ca", "abc", 2), ("", "ab", 2), ("kitten", "sitting", 3)])
def test_edits(a, b, n):
    assert inverted.edits(a, b) == inverted.edits(b, a) == n


def test_fuzzy_terms_are_all_found(spark):
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 9))) for _ in range(250)})
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r["word"], r["term"]): r["edits"] for r in inverted.fuzzy(terms.withColumnRenamed("term", "word"), inverted.deletions(terms)).collect()}
    allowed = lambda w: 2 if len(w) >= 7 else 1 if len(w) >= 4 else 0
    want = {(a, b): n for a in words for b in words if a[:2] == b[:2] and (n := inverted.edits(a, b)) <= allowed(a)}
    assert got == want


def test_fields_and_phrases_rank(spark, tables):
    queries = spark.createDataFrame([(1, ["salmno", "recovery"]), (2, ["tax"]), (3, ["nowhere"]), (4, [])], "qid long, words array<string>")
    exact = inverted.ranked_fields(tables, queries, k=5).collect()
    assert {r["qid"] for r in exact} == {2}
    near = inverted.ranked_fields(tables, queries, variants=tables["variants"], k=5).collect()
    best = next(r for r in near if r["qid"] == 1 and r["place"] == 1)
    assert "salmon recovery" in " ".join(analysis.words_of((TEXTS + [""] * 100)[best["key"]])) or best["key"] >= len(TEXTS)
    traits = spark.createDataFrame([(r["key"], 1.0, i == 3, None) for i, r in enumerate([x for x in exact if x["qid"] == 2])], "key long, weight double, latest boolean, acted_within_days int")
    lifted = [r for r in inverted.ranked_fields(tables, queries, traits, k=5).collect() if r["qid"] == 2]
    assert lifted[0]["key"] == [x for x in exact if x["qid"] == 2][3]["key"]


def test_completion_and_similar_titles(spark, tmp_path):
    rows = [(1, "Salmon recovery act", ["HB 1019", "HB1019"]), (2, "Recovering salmon", ["SB 1019"]), (3, None, None), (4, "Board act", ["HB 77"])]
    docs = spark.createDataFrame(rows, "id long, title string, forms array<string>")
    inverted.save({"prefixes": inverted.completions(docs.withColumn("forms", F.coalesce("forms", F.array().cast("array<string>"))), "id", "title", "forms")}, f"file://{tmp_path}/p", buckets=4)
    prefixes = spark.read.parquet(f"file://{tmp_path}/p/prefixes")
    assert [r["key"] for r in inverted.complete(prefixes, "HB 10").collect()] == [1] and [r["key"] for r in inverted.complete(prefixes, "Recov").collect()] == [2, 1]
    assert [r["key"] for r in inverted.complete(prefixes, "salmon rec").collect()] == [1] and inverted.complete(prefixes, "zzz").count() == 0
    grams = inverted.grams_of(docs, "id", "title")
    asked = spark.createDataFrame([(9, "salmon recovery")], "qid long, text string")
    got = {r["key"]: r["score"] for r in inverted.similar_titles(grams, asked).collect()}
    every = docs.where("title is not null").select("id", search.op.jaccard(search.trigrams(F.col("title")), search.trigrams(F.lit("salmon recovery"))).alias("s")).collect()
    assert got == {r["id"]: pytest.approx(r["s"]) for r in every if r["s"] > 0.3}


def test_no_task_gathers_beginnings_or_pairs_of_many_keys(spark):
    """Beginnings and similar titles equal a plain version, also where keys repeat, and are never grouped themselves."""
    rows = [(1, "large ring", ["P1"]), (1, "ring large", ["p1", ""]), (2, "hot bolt ring", ["p2"]), (None, "large", ["x"]), (3, "", ["q"]), (4, "lone", None)]
    docs = spark.createDataFrame(rows, "id int, title string, forms array<string>")
    want = {}
    for key, title, forms in rows:
        words = title.split()
        shingled = [" ".join(words[i : i + n]) for i in range(len(words)) for n in (2, 3) if i + n <= len(words)]
        for kind, values in (("number", [f.lower() for f in forms or [] if f]), ("word", words), ("shingle", shingled)) if forms is not None else ():
            for place, value in enumerate(values):
                for n in range(1, min(12, len(value)) + 1):
                    want[value[:n], key, kind] = min(place, want.get((value[:n], key, kind), place))
    made = inverted.completions(docs, "id", "title", "forms")
    got = [tuple(r) for r in made.select("prefix", "key", "kind", "place").collect()]
    assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want
    titles = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([("large", "ring"), ("large", "bolt"), ("enlarged", "rings"), ("x",), ("",)])], "id int, title string")
    asked = spark.createDataFrame([("a", "a large ring of rings"), ("b", "bolt"), ("c", "")], "qid string, text string")
    grams = lambda t: {w[i : i + 3] for w in (f"  {x} " for x in t.split()) for i in range(len(w) - 2)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for least in (0.0, 0.05, 0.3, 0.6):
        pairs = {(q, k): len(grams(t) & grams(u)) / len(grams(t) | grams(u)) for q, u in asked.collect() for k, t in titles.collect() if grams(t) and grams(u)}
        found = inverted.similar_titles(inverted.grams_of(titles, "id", "title"), asked, least)
        assert {(r["qid"], r["key"]): round(r["score"], 9) for r in found.collect()} == {p: round(s, 9) for p, s in pairs.items() if s > least}
        assert "Aggregate [qid" not in plan(found)
    assert "Aggregate [prefix" not in plan(made)


def test_terms_are_counted_from_saved_postings(spark, tmp_path):
    """Keys that repeat are one document, folded and plain words are the same terms, and counts come from what was written."""
    docs = spark.createDataFrame([(1, "Ax's ax & ÉTÉ"), (1, "ax oak"), (None, "oak’s"), (2, ""), (3, None), (4, "été ete's")], "id int, body string")
    built = inverted.build(docs, "id", ["body"], stemmed=False)
    assert {(r["term"], r["key"]): (r["at"], r["n"]) for r in built["postings"].where("key IS NULL OR key <> 1").collect()} == {("oak", None): ([0], 1), ("ete", 4): ([0, 1], 2)}
    assert {r["term"]: r["at"] for r in built["postings"].where("key = 1").collect()} == {"ax": [0, 0, 1], "and": [2], "ete": [3], "oak": [1]}
    twice = built["postings"].unionByName(built["postings"].where("term = 'ax'").withColumn("key", F.lit(9)))
    at = f"file://{tmp_path}/i"
    inverted.save(built | {"postings": twice}, at, buckets=4, stemmed=False)
    got = inverted.load(spark, at, "terms", "stems", "fields")
    assert {r["term"]: r["df"] for r in got["terms"].collect()} == {"ax": 2, "and": 1, "ete": 2, "oak": 2}
    assert sorted(r["term"] for r in got["stems"].collect()) == ["and", "ax", "ete", "oak"] and got["fields"].first()["docs"] == 4


def test_texts_and_postings_are_not_dealt_out(spark, tmp_path):
    """Where keys don't repeat, postings are made and saved where their documents are read; asked words alone travel to them."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.createDataFrame([(i, f"the road {i}", f"the road of the county {i} and bill {i % 3}") for i in range(30)], "id long, title string, body string").repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    at = f"file://{tmp_path}/index"
    built = inverted.build(docs, "id", ["title", "body"], stemmed=False)
    assert "Exchange" not in plan(built["postings"])
    inverted.save(built, at, buckets=2, stemmed=False)
    files = list((tmp_path / "index" / "postings").rglob("*.parquet"))
    assert len(files) > 2  # a task's own in each folder
    tables = inverted.load(spark, at, *built)
    assert Counter((r["term"], r["key"], r["field"], tuple(r["at"]), r["n"]) for r in tables["postings"].collect()) == Counter((r["term"], r["key"], r["field"], tuple(r["at"]), r["n"]) for r in built["postings"].collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        queries = spark.createDataFrame([(1, ["the", "road"]), (2, ["county", "county"])], "qid long, words array<string>")
        for found in (inverted.best_fields(tables, queries, {"body": 1.0}), inverted.near_phrases(tables, queries, {"title": 1.0})):
            assert "hashpartitioning(term#" not in plan(found) and "BroadcastHashJoin" in plan(found)
        assert {(r["qid"], r["key"]) for r in inverted.best_fields(tables, queries, {"body": 1.0}).collect()} == {(q, i) for q in (1, 2) for i in range(30)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("limit", [1 << 16, 0])
def test_documents_of_repeated_and_null_keys_are_one(spark, monkeypatch, limit):
    monkeypatch.setattr(inverted, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame([(1, "a b a"), (None, "c d"), (2, "a c"), (1, "b b"), (None, "d"), (3, None)], "id long, body string")
    got = {(r["term"], r["key"]): sorted(r["at"]) for r in inverted.build(docs, "id", ["body"], stemmed=False)["postings"].collect()}
    assert got == {("a", 1): [0, 2], ("b", 1): [0, 1, 1], ("c", None): [0], ("d", None): [0, 1], ("a", 2): [0], ("c", 2): [1]}
