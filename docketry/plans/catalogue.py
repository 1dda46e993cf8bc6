"""Queries over the driver's tables, each with a SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import clauses, refs, text
from docketry.operators import relational as op

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, and its twin."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from docketry.plans import domain, legislative, searching  # noqa: F401  each registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(column: str = "text"):
    return F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
TERM = "the"


@query(f"""
WITH m AS (SELECT doc_id, source, lang, CAST(len(list_filter({TOKENS}, lambda w: w = '{TERM}')) AS BIGINT) AS score FROM documents WHERE lang IN ('en', 'de')),
c AS (SELECT DISTINCT ON (source) doc_id, source, lang, score FROM m WHERE score > 0 ORDER BY source, score DESC, doc_id)
SELECT doc_id, source, lang, score FROM c ORDER BY score DESC, doc_id LIMIT 10
""")
def search_page(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(op.all_of([op.one_of("lang", ["en", "de"])]))
    scored = docs.select("doc_id", "source", "lang", F.size(F.filter(tokens(), lambda w: w == TERM)).cast("long").alias("score")).where("score > 0")
    best = op.collapse(scored, ["source"], [F.col("score").desc(), F.col("doc_id")])
    return op.page(best, [F.col("score").desc(), F.col("doc_id")], 10)


@query("""
SELECT 'lang' AS facet, lang AS key, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source
UNION ALL SELECT 'long', CASE WHEN n_chars > 2000 THEN 'true' ELSE 'false' END, count(*) FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL
""")
def search_facets(spark, sf_dir):
    return op.facets(read(spark, sf_dir, "documents"), {"lang": "lang", "source": "source", "long": F.col("n_chars") > 2000})


@query(f"""
SELECT 'word' AS facet, key, n FROM (
  SELECT key, count(*) AS n FROM (SELECT unnest(list_distinct({TOKENS})) AS key FROM documents) GROUP BY key)
ORDER BY n DESC, key LIMIT 30
""")
def facets_array(spark, sf_dir):
    return op.facets(read(spark, sf_dir, "documents"), {}, {"word": tokens()}, {"word": 30})


@query("SELECT DISTINCT ON (user_id) user_id, event_id, value FROM events ORDER BY user_id, value DESC NULLS LAST, event_id")
def collapse_best(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return op.collapse(events, ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")])


@query("""
SELECT user_id, event_id, CAST(r - 1 AS INTEGER) AS hit FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS r FROM events WHERE user_id IS NOT NULL)
WHERE r BETWEEN 2 AND 3
""")
def inner_hits(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return op.inner_hits(events, ["user_id"], [F.col("value").desc_nulls_last(), F.col("event_id")]).select("user_id", "event_id", "hit")


@query("SELECT count(DISTINCT coalesce(CAST(o_custkey AS VARCHAR), 'o' || o_orderkey)) AS total FROM orders")
def total_distinct(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.countDistinct(F.coalesce(F.col("o_custkey").cast("string"), F.concat(F.lit("o"), F.col("o_orderkey")))).alias("total"))


@query(f"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, ['licensed', 'version', 'public'])")
def array_overlap(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", tokens().alias("words"))
    return docs.where(op.overlaps("words", ["licensed", "version", "public"])).select("doc_id")


@query("""
SELECT c_custkey FROM customer
WHERE c_nationkey % 3 = 0 OR (c_nationkey % 3 = 1 AND c_nationkey % 2 = 0) OR c_custkey % 7 = 3
""")
def rls_filter(spark, sf_dir):
    n = F.col("c_nationkey")
    granted = read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(n % 3 == 0, "public").otherwise("restricted").alias("visibility"),
        F.when((n % 3 == 1) & (n % 2 == 0), F.array(F.lit("reviewer"))).otherwise(F.array().cast("array<string>")).alias("allowed_roles"),
        F.array(F.concat(F.lit("user"), F.col("c_custkey") % 7)).alias("allowed_users"),
    )
    return granted.where(op.visible_to(["drafter", "reviewer"], "user3")).select("c_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1996-03-04 00:00:00' AND o_orderstatus <> 'F'")
def date_window(spark, sf_dir):
    as_of = F.to_timestamp_ntz(F.lit("1996-03-01 00:00:00"))
    return read(spark, sf_dir, "orders").where(op.window_from("o_orderdate", as_of) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_orderdate")


_PAGE = "SELECT o_orderkey, o_orderdate FROM orders {} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51"
_CURSOR = ("1997-01-01 00:00:00", 5000)


@query(_PAGE.format(""))
def keyset_page1(spark, sf_dir):
    return op.keyset_page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50)


@query(_PAGE.format(f"WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '{_CURSOR[0]}', {_CURSOR[1]})"))
def keyset_page2(spark, sf_dir):
    return op.keyset_page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50, _CURSOR)


@query("""
SELECT o_orderkey, o_totalprice, c_name, n_name, r_name
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'O'
""")
def feed_enrich(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left").select("n_nationkey", "n_name", "r_name")
    return orders.join(customers, "o_custkey").join(nations, "n_nationkey", "left").select("o_orderkey", "o_totalprice", "c_name", "n_name", "r_name")


@query("""
SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def nest_children(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = op.nest(read(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"], "rows")
    return nested.select("o_orderkey", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["l_linenumber"], r["l_partkey"])), ",").alias("lines"))


@query("""
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def upsert_latest(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    newest = [F.col("event_id").desc()]
    return op.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id", "event_type"], newest)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'removed' WHEN c_custkey % 5 = 0 AND c_acctbal <> 0 THEN 'changed' ELSE 'same' END AS change FROM customer
UNION ALL SELECT -c_custkey, 'added' FROM customer WHERE c_custkey % 13 = 0 AND c_custkey <> 0
""")
def snapshot_changes(spark, sf_dir):
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, -F.col("c_acctbal")).otherwise(F.col("c_acctbal")))
    new = new.unionByName(old.where("c_custkey % 13 = 0 AND c_custkey <> 0").withColumn("c_custkey", -F.col("c_custkey")))
    return op.snapshot_changes(old, new, ["c_custkey"], ["c_name", "c_acctbal"])


@query("""
SELECT event_id, event_type = 'error' OR (user_id % 3 = 0 AND ts > TIMESTAMP '2024-01-15 00:00:00') AS cancelled FROM events
""")
def soft_delete(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("cancelled"))
    seen = rows.where("user_id % 3 <> 0")
    return op.soft_delete(rows, seen, "event_id", "ts", F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).select("event_id", "cancelled")


@query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS digest FROM documents GROUP BY 2")
def dedupe_first(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("digest"))
    return op.first_of_each(docs, F.col("digest"), [F.col("doc_id")])


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS occurrence FROM events")
def running_occurrence(spark, sf_dir):
    return op.running_occurrence(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "occurrence")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations
""")
def carry_forward(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return op.carry_forward(turns, ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@query("""
SELECT event_id, event_id_asof FROM (
  SELECT event_id, event_type, arg_max(CASE WHEN event_type = 'view' THEN event_id END, CASE WHEN event_type = 'view' THEN (ts, event_id) END)
           OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS event_id_asof FROM events)
WHERE event_type = 'purchase'
""")
def asof_backward(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    bought, seen = events.where("event_type = 'purchase'"), events.where("event_type = 'view'")
    return op.asof_backward(bought, seen, ["user_id"], "ts", ["event_id"], "event_id").select("event_id", "event_id_asof")


@query("SELECT event_id FROM events WHERE NOT (event_id % 4 = 1 AND event_type IN ('view', 'click'))")
def unconsumed(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "event_type")
    return op.unconsumed(events, events.where("event_id % 4 = 1").where(op.one_of("event_type", ["view", "click"])), "event_id").select("event_id")


@query("SELECT 'c' || o_custkey AS participant FROM orders UNION SELECT 's' || s_suppkey FROM supplier")
def union_participants(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("participant"))
    b = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("participant"))
    return a.union(b).distinct()


@query("""
SELECT level, prefix, count(*) AS n FROM (
  SELECT unnest(['one', 'two', 'three']) AS level, unnest([CASE WHEN len(p) >= 1 THEN array_to_string(p[:1], ' ') END, CASE WHEN len(p) >= 2 THEN array_to_string(p[:2], ' ') END, CASE WHEN len(p) >= 3 THEN array_to_string(p[:3], ' ') END]) AS prefix
  FROM (SELECT string_split(p_type, ' ') AS p FROM part)) WHERE prefix IS NOT NULL GROUP BY ALL
""")
def rollup_path(spark, sf_dir):
    return op.prefix_rollup(read(spark, sf_dir, "part"), F.col("p_type"), " ", ["one", "two", "three"])


_CITE = "(l_suppkey % 40 + 1) || '.' || (l_partkey % 30) || '.' || (l_partkey % 900 + 5)"


@query(f"""
SELECT cite, CAST(row_number() OVER (PARTITION BY flag ORDER BY array_to_string(list_transform(string_split(cite, '.'), lambda p: lpad(p, 6, '0')), '.')) AS INTEGER) AS place, flag
FROM (SELECT DISTINCT {_CITE} AS cite, l_returnflag AS flag FROM lineitem)
""")
def dotted_sort(spark, sf_dir):
    from pyspark.sql import Window

    cite = F.concat_ws(".", F.col("l_suppkey") % 40 + 1, F.col("l_partkey") % 30, F.col("l_partkey") % 900 + 5)
    cites = read(spark, sf_dir, "lineitem").select(cite.alias("cite"), F.col("l_returnflag").alias("flag")).distinct()
    return cites.withColumn("place", F.row_number().over(Window.partitionBy("flag").orderBy(op.dotted_key(F.col("cite")))))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_project(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


_NO = "lpad(CAST(p_partkey % 900 + 100 AS VARCHAR), 3, '0')"


@query(f"""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '82.04.' || {_NO} || ',82.08.' || {_NO} || ',9A.36.021,70A.15' WHEN 1 THEN '9.94A,' || p_size WHEN 2 THEN '77.15' WHEN 5 THEN '9A.36.021,9.94A.030,70A.20,70A.25' ELSE '' END AS cites FROM part
""")
def cite_extract(spark, sf_dir):
    """Citations in sentences about every part: lists after one keyword, chapters, titles, and numbers that cite nothing."""
    k, no = F.col("p_size") % 6, F.lpad((F.col("p_partkey") % 900 + 100).cast("string"), 3, "0")
    one = F.concat(F.lit("amending RCW 82.04."), no, F.lit(", 82.08."), no, F.lit(" and 9A.36.021; reenacting chapter 70A.15 RCW of "), F.col("p_name"))
    two = F.concat(F.lit("relating to Title "), F.col("p_size"), F.lit(" RCW and chapter 9.94A RCW"))
    sentence = F.when(k == 0, one).when(k == 1, two).when(k == 2, F.concat(F.col("p_name"), F.lit(" under chapter 77.15 RCW and RCW 77.15"))).when(k == 3, F.concat(F.lit("no citation 12.34.567 here: "), F.col("p_retailprice")))
    sentence = sentence.when(k == 4, F.concat(F.lit("amending chapter 5, 1996 Laws; Title 9 of the code, and chapter "), "p_size", F.lit(", Laws of 2023")))
    sentence = sentence.otherwise("chapter 12, Laws of 2023; RCW 9A.36.021, and 9.94A.030; chapters 70A.20, and 70A.25 RCW; Title 9, RCW")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(clauses.cites_in(sentence), ",").alias("cites"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 6 WHEN 0 THEN -CAST(floor(l_extendedprice) AS DOUBLE) WHEN 1 THEN CAST(floor(l_extendedprice) AS DOUBLE) WHEN 2 THEN NULL WHEN 3 THEN CAST(l_quantity AS DOUBLE) WHEN 4 THEN -CAST(l_quantity AS DOUBLE) END AS value FROM lineitem
""")
def num_parse(spark, sf_dir):
    """Amounts of every line as cells show them: in parentheses, with separators, blank, in per cent, negative, or no number."""
    n, q = F.col("l_linenumber") % 6, F.col("l_quantity").cast("string")
    whole = F.format_number(F.floor(F.col("l_extendedprice")), 0)
    cell = F.when(n == 0, F.concat(F.lit("$("), whole, F.lit(")"))).when(n == 1, F.concat(F.lit(" $"), whole)).when(n == 2, "-").when(n == 3, F.concat(q, F.lit("%"))).when(n == 4, F.concat(F.lit("-"), q)).otherwise(F.concat(q, F.lit(" n/a")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", text.parse_number(cell).alias("value"))


@query("SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS shown FROM orders")
def num_format(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.format_whole(F.col("o_totalprice")).alias("shown"))


# Clocks from 2007 on: summer time from the second Sunday of March to the first of November, at two in the morning.
_SPRING, _FALL = "make_date(2026, 3, 8) + INTERVAL 2 HOUR", "make_date(2026, 11, 1) + INTERVAL 2 HOUR"


@query(f"""
WITH e AS (SELECT event_id, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL (event_id * 37 % 525600) MINUTE AS local FROM events)
SELECT event_id, local + CASE WHEN local >= {_SPRING} AND local < {_FALL} THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS utc FROM e
""")
def pacific_utc(spark, sf_dir):
    """A minute of 2026 for every event, both changes of clocks among them."""
    minute = (F.col("event_id") * 37 % 525600).cast("int")
    local = F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")) + F.make_interval(mins=minute)
    return read(spark, sf_dir, "events").select("event_id", text.pacific_to_utc(local).alias("utc"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_orderkey % 4000 + 1000 AS h, o_orderkey % 3000 + 5000 AS s, year(o_orderdate) - (year(o_orderdate) + 1) % 2 AS y FROM orders)
SELECT o_orderkey, CASE WHEN k <= 4 THEN 'bill' WHEN k = 5 THEN 'rcw' WHEN k = 6 THEN 'session_law' WHEN k = 7 THEN 'initiative' WHEN k = 8 THEN 'fiscal_note_package' END AS kind,
  CASE k WHEN 0 THEN 'WA:2025-26:HB' || h WHEN 1 THEN 'WA:2025-26:SB' || s WHEN 2 THEN 'WA:' || y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') || ':SJR' || s WHEN 3 THEN 'WA:2025-26:SB' || s WHEN 4 THEN 'WA:2025-26:SB' || s
    WHEN 5 THEN '43.88.' || lpad(CAST(o_orderkey % 900 + 100 AS VARCHAR), 3, '0') WHEN 6 THEN '2023 c ' || o_orderkey % 500 WHEN 7 THEN 'I-' || o_orderkey % 9000 + 100 WHEN 8 THEN 'P' || o_orderkey % 90000 + 100 END AS target,
  CASE k WHEN 0 THEN 'I' WHEN 1 THEN 'S2.E' WHEN 2 THEN 'S' WHEN 3 THEN 'S2.E' WHEN 4 THEN 'I' END AS version_code, CASE WHEN k = 4 THEN 'S4812.1' END AS drafter FROM o
""")
def ref_parse(spark, sf_dir):
    """A reference about every order, in ten spellings."""
    key, k, h, s = F.col("o_orderkey"), F.col("o_orderkey") % 10, (F.col("o_orderkey") % 4000 + 1000).cast("string"), (F.col("o_orderkey") % 3000 + 5000).cast("string")
    forms = [
        (F.lit("H.B. "), h), (F.lit("engrossed second substitute senate bill "), s), (F.lit("SSJR "), s, F.lit(" ("), F.year("o_orderdate"), F.lit(")")), (F.lit(""), s, F.lit("-S2.E")), (F.lit("SB "), s, F.lit(" amendment S-4812.1")),
        (F.lit("rcw 43.88."), F.lpad((key % 900 + 100).cast("string"), 3, "0")), (F.lit("Chapter "), key % 500, F.lit(", Laws of 2023 PV")), (F.lit("Initiative Measure No. "), key % 9000 + 100), (F.lit("fiscal note package # "), key % 90000 + 100), (F.lit("hello "), F.col("o_orderstatus")),
    ]
    written = F.element_at(F.array(*[F.concat(*f) for f in forms]), (k + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", refs.parse_column(written, "2025-26").alias("r"))
    r = F.col("r")
    target = (
        F.when(r["kind"] == "bill", F.concat(F.lit("WA:"), r["biennium"], F.lit(":"), r["type"], r["number"]))
        .when(r["kind"] == "rcw", r["cite"])
        .when(r["kind"] == "session_law", F.concat(r["year"], F.lit(" c "), r["chapter"]))
        .when(r["kind"] == "initiative", F.concat(F.lit("I-"), r["number"]))
        .when(r["kind"] == "fiscal_note_package", F.concat(F.lit("P"), r["number"]))
    )
    return rows.select("o_orderkey", r["kind"].alias("kind"), target.alias("target"), r["version_code"].alias("version_code"), r["drafter_number"].alias("drafter"))


@query(r"SELECT doc_id, 'sha256:' || sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x{FEFF}]+', ' ', 'g'), '^ | $', '', 'g')) AS text_hash FROM documents")
def text_hash(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.text_hash(text.normalize_space(F.coalesce("text", F.lit("")))).alias("text_hash"))


_CELLS = """SELECT l_returnflag AS flag, l_shipmode AS status, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM (SELECT l_returnflag, l_linestatus AS l_shipmode, l_quantity FROM lineitem WHERE year(l_shipdate) = {}) GROUP BY ALL"""


@query(f"SELECT flag, status, a.value AS before, b.value AS after FROM ({_CELLS.format(1994)}) a FULL JOIN ({_CELLS.format(1996)}) b USING (flag, status) WHERE a.value IS DISTINCT FROM b.value")
def cell_diff(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("y"), "l_quantity")
    sums = lambda y: lines.where(F.col("y") == y).groupBy("flag", "status").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))
    return op.cell_changes(sums(1994), sums(1996), ["flag", "status"], "value")


@query("""
WITH y AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM orders WHERE year(o_orderdate) <= 1997 GROUP BY ALL),
p AS (SELECT priority, y - (y + 1) % 2 AS first, sum(CASE WHEN y % 2 = 1 THEN v END) AS a, sum(CASE WHEN y % 2 = 0 THEN v END) AS b FROM y GROUP BY ALL)
SELECT priority, CAST(first AS INTEGER) AS first, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS total FROM p
""")
def biennium_sum(spark, sf_dir):
    years = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v")).where("y <= 1997")
    years = years.groupBy("priority", "y").agg(F.sum("v").cast("double").alias("v")).withColumn("first", F.col("y") - (F.col("y") + 1) % 2)
    pairs = years.groupBy("priority", "first").agg(F.sum(F.when(F.col("y") % 2 == 1, F.col("v"))).alias("a"), F.sum(F.when(F.col("y") % 2 == 0, F.col("v"))).alias("b"))
    return pairs.select("priority", "first", op.pair_sum(F.col("a"), F.col("b")).alias("total"))


@query("""
WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice AS stated, lines FROM orders JOIN s ON o_orderkey = l_orderkey WHERE NOT abs(o_totalprice - lines) <= 0.5
""")
def reconcile(spark, sf_dir):
    sums = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("stated"))
    return orders.join(sums, "o_orderkey").where(~op.near(F.col("stated"), F.col("lines")))


@query(f"""
WITH d AS (SELECT doc_id, list_distinct({TOKENS}) AS ws FROM documents), b AS (SELECT item_id, list_distinct({TOKENS}) AS ws FROM benchmark),
n AS (
  SELECT doc_id, item_id, na, nb, count(*) AS shared FROM (SELECT doc_id, len(ws) AS na, unnest(ws) AS w FROM d) JOIN (SELECT item_id, len(ws) AS nb, unnest(ws) AS w FROM b) USING (w) GROUP BY ALL)
SELECT doc_id, item_id, shared / CAST(na + nb - shared AS DOUBLE) AS score FROM n WHERE score >= 0.1
""")
def jaccard_pairs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(tokens()).alias("a"))
    items = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens()).alias("b"))
    return op.similar_pairs(docs, items, 0.1)
