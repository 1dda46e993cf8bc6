"""Queries of the legislative operators over the driver's tables: orders stand for bills, their lines for what bills have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import clauses, refs, text
from docketry.operators import bills as bill_ops
from docketry.operators import diff, estimate, formula, notes, search, workflow
from docketry.operators import relational as op
from docketry.plans.catalogue import TOKENS, query, read
from docketry.plans.domain import scratch
from docketry.sources import bills, documents

# Name parts of version files by line number, and the codes and sequences that they mean: seven by name, then substitutes
# from the third on, then engrossed ones.
VERSIONS = [("", "I", 0), ("-S", "S", 10), ("-S.E", "S.E", 11), ("-S2", "S2", 20), ("-S2.E2", "S2.E2", 22), (".PL", "PL", 100), ("-S.SL", "S.SL", 210)]
VERSIONS += [(f"-S{n}", f"S{n}", 10 * n) for n in range(3, 10)] + [(f"-S{n}.E", f"S{n}.E", 10 * n + 1) for n in range(2, 10)]
SUFFIX = [suffix for suffix, _, _ in VERSIONS]
CODES = f"(VALUES {', '.join(f"({n}, '{code}', {seq})" for n, (_, code, seq) in enumerate(VERSIONS, 1))}) AS codes(n, code, seq)"


# The tables repeat numbers within an order: its lines are numbered anew, in the order of their numbers and values.
ORDERED = ("l_linenumber", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_extendedprice")
LINEITEM = f"(SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDERED)}) AS INTEGER) AS l_linenumber), l_shipdate AS l_commitdate, 'M' || l_suppkey % 7 AS l_shipmode FROM lineitem)"


def lines(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", *ORDERED)
    rows = rows.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDERED)))
    return rows.withColumn("l_commitdate", F.col("l_shipdate")).withColumn("l_shipmode", F.concat(F.lit("M"), F.col("l_suppkey") % 7))


def held(df):
    """The rows written and read again, for what several results read."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def line_arrays(spark, sf_dir):
    """Orders with their lines as one array."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_shipdate").alias("ship"), F.col("l_commitdate").alias("commit"), "l_returnflag", "l_linestatus", "l_shipmode")
    own = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("x"))
    return read(spark, sf_dir, "orders").join(own, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "x")


def records(spark, sf_dir, hold=lambda df: df):
    """Orders as bill records with their lines as texts, amendments, hearings, notes and history."""
    o = hold(line_arrays(spark, sf_dir))
    key = F.col("o_orderkey")
    link = lambda s: F.concat(F.lit("http://x/"), (key % 9000 + 1000).cast("string"), F.element_at(F.array(*map(F.lit, SUFFIX)), s["n"]), F.lit(".xml"))
    each = lambda make, keep=None: F.transform("x" if keep is None else F.filter("x", keep), make)
    return o.select(
        key.alias("bill_id"), F.md5(F.concat_ws("|", key, "o_orderstatus")).alias("change_hash"), (key % 8).cast("int").alias("status"),
        F.when(key % 5 == 0, "0000-00-00").otherwise(day("o_orderdate")).alias("status_date"), F.struct(F.year("o_orderdate").alias("year_start")).alias("session"),
        F.concat(F.when(key % 2 == 0, "HB").otherwise("SJR"), key.cast("string")).alias("bill_number"), F.concat(F.lit("Title "), F.col("o_orderpriority")).alias("title"), F.col("o_orderpriority").alias("description"),
        F.struct(F.concat(F.lit("Committee "), key % 3).alias("name")).alias("committee"),
        each(lambda s: F.struct(day(s["commit"]).alias("date"), F.when(s["n"] == 2, "Chapter 5, 1996 Laws.").otherwise(F.concat(F.lit("Reading "), s["n"])).alias("action"))).alias("history"),
        F.array(*[F.struct(F.lit(i).cast("long").alias("people_id"), F.concat(F.lit(f"P{i}-"), F.col("o_custkey")).alias("name"), F.lit(f"L{i}").alias("last_name"), F.lit(3 - i).alias("sponsor_order")) for i in (1, 2)]).alias("sponsors"),
        F.when(key % 3 == 0, F.array(F.struct(F.lit("Crossfiled").alias("type"), F.concat(F.lit("SB"), key).alias("sast_bill_number")))).otherwise(F.array(F.struct(F.lit("Other").alias("type"), F.lit("x").alias("sast_bill_number")))).alias("sasts"),
        each(lambda s: F.struct(s["n"].cast("long").alias("doc_id"), day(s["ship"]).alias("date"), F.lit("x").alias("type"), link(s).alias("state_link"), F.md5(link(s)).alias("text_hash"))).alias("texts"),
        each(lambda s: F.struct((key * 100 + s["n"]).alias("amendment_id"), (s["l_linestatus"] == "F").cast("int").alias("adopted"), F.concat(F.lit("to "), s["l_shipmode"]).alias("title"), F.when(s["n"] % 2 == 0, "adopted 01/02/2025").alias("description"), F.concat(F.lit("http://x/1500 AMH WM H"), F.lpad((key % 9999).cast("string"), 4, "0"), F.lit(".1.pdf")).alias("state_link"), day(s["ship"]).alias("date"), F.lit("h").alias("amendment_hash")), lambda s: s["l_returnflag"] == "R").alias("amendments"),
        each(lambda s: F.struct(F.concat(F.lit("s"), s["n"]).cast("string").alias("supplement_id"), day(s["ship"]).alias("date"), F.when(s["n"] % 2 == 1, "Fiscal Note").otherwise("Analysis").alias("type"), s["l_shipmode"].alias("description"), link(s).alias("state_link"))).alias("supplements"),
        each(lambda s: F.struct(s["n"].cast("string").alias("event_hash"), day(s["ship"]).alias("date"), F.when(s["n"] % 2 == 1, "8:30").otherwise("tba").alias("time"), s["l_shipmode"].alias("location"), F.when(s["n"] % 3 == 0, "Public Hearing on it").when(s["n"] % 3 == 1, "Executive action").alias("description"))).alias("calendar"),
    )


BIENNIUM = "(CAST(year(o_orderdate) - (year(o_orderdate) + 1) % 2 AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) - (year(o_orderdate) + 1) % 2 + 1) % 100 AS VARCHAR), 2, '0'))"
NUMBER = "((CASE WHEN o_orderkey % 2 = 0 THEN 'HB' ELSE 'SJR' END) || o_orderkey)"
BILL_KEY = f"('WA:' || {BIENNIUM} || ':' || {NUMBER})"
LINES = f"SELECT *, {BILL_KEY} AS bill_key FROM orders JOIN {LINEITEM} ON o_orderkey = l_orderkey"
STATUS = "CASE o_orderkey % 8 WHEN 1 THEN 'introduced' WHEN 2 THEN 'engrossed' WHEN 3 THEN 'enrolled' WHEN 4 THEN 'passed' WHEN 5 THEN 'vetoed' WHEN 6 THEN 'failed' ELSE 'unknown' END"


@query(f"""
WITH l AS ({LINES}), h AS (
  SELECT o_orderkey, CAST(max(l_commitdate) AS DATE) AS last_action_date,
    max(struct_pack(d := CAST(l_commitdate AS DATE), a := CASE WHEN l_linenumber = 2 THEN 'Chapter 5, 1996 Laws.' ELSE 'Reading ' || l_linenumber END)).a AS last_action,
    bool_or(l_linenumber = 2) AS passed FROM l GROUP BY 1)
SELECT {BILL_KEY} AS bill_key, {BIENNIUM} AS biennium, CASE WHEN o_orderkey % 2 = 0 THEN 'HB' ELSE 'SJR' END AS type, CAST(o_orderkey AS INTEGER) AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'H' ELSE 'S' END AS chamber,
  {STATUS} AS status, CASE {STATUS} WHEN 'introduced' THEN 'in_committee' WHEN 'engrossed' THEN 'passed_origin' WHEN 'enrolled' THEN 'passed_legislature' WHEN 'passed' THEN 'passed' WHEN 'vetoed' THEN 'vetoed' WHEN 'failed' THEN 'failed' ELSE 'prefiled' END AS search_status,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS status_date, 'Committee ' || o_orderkey % 3 AS committee, last_action_date, last_action, CASE WHEN o_orderkey % 3 = 0 THEN 'SB' || o_orderkey END AS companion,
  CASE WHEN passed THEN 'Chapter 5, 1996 Laws' END AS chapter_law, 'P2-' || o_custkey AS first_sponsor
FROM orders JOIN h USING (o_orderkey)
""")
def ingest_bills(spark, sf_dir):
    out = bills.bills_table(records(spark, sf_dir))
    return out.select("bill_key", "biennium", "type", "number", "chamber", "status", "search_status", "status_date", "committee", "last_action_date", "last_action", "companion", "chapter_law", F.get("sponsors", F.lit(0))["name"].alias("first_sponsor"))


@query(f"SELECT bill_key, code AS version_code, CAST(seq AS INTEGER) AS seq, CAST(n AS BIGINT) AS doc_id, CAST(l_shipdate AS DATE) AS date, 'pending' AS status FROM ({LINES}) JOIN {CODES} ON n = l_linenumber")
def ingest_versions(spark, sf_dir):
    return bills.versions_table(records(spark, sf_dir)).select("bill_key", "version_code", "seq", "doc_id", "date", "status")


@query(f"SELECT bill_key, l_orderkey * 100 + l_linenumber AS amendment_id, 'to ' || l_shipmode AS title, 'H' || lpad(CAST(l_orderkey % 9999 AS VARCHAR), 4, '0') || '.1' AS drafter_number, 'H' AS chamber, l_linestatus = 'F' OR l_linenumber % 2 = 0 AS adopted, CAST(l_shipdate AS DATE) AS date FROM ({LINES}) WHERE l_returnflag = 'R'")
def ingest_amendments(spark, sf_dir):
    return bills.amendments_table(records(spark, sf_dir)).select("bill_key", "amendment_id", "title", "drafter_number", "chamber", "adopted", "date")


# Clocks of 1987 to 2006: summer time from the first Sunday of April to the last of October, at two in the morning.
SUMMER = "(local >= make_date(year(local), 4, 1) + CAST((7 - dayofweek(make_date(year(local), 4, 1))) % 7 AS INTEGER) + INTERVAL 2 HOUR AND local < make_date(year(local), 10, 31) - CAST(dayofweek(make_date(year(local), 10, 31)) AS INTEGER) + INTERVAL 2 HOUR)"
HEARINGS = f"SELECT *, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + CASE WHEN l_linenumber % 2 = 1 THEN INTERVAL 510 MINUTE ELSE INTERVAL 0 MINUTE END AS local FROM ({LINES})"


@query(f"""
SELECT bill_key || ':' || l_linenumber AS id, bill_key, CASE l_linenumber % 3 WHEN 0 THEN 'public_hearing' WHEN 1 THEN 'executive_session' ELSE 'other' END AS kind,
  local + CASE WHEN {SUMMER} THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS starts, l_shipmode AS location, false AS cancelled FROM ({HEARINGS})
""")
def ingest_hearings(spark, sf_dir):
    return bills.hearings_table(records(spark, sf_dir)).withColumnRenamed("at", "starts")


@query(f"SELECT bill_key || ':s' || l_linenumber AS id, bill_key, l_shipmode AS description, CAST(l_shipdate AS DATE) AS date FROM ({LINES}) WHERE l_linenumber % 2 = 1")
def ingest_prior_notes(spark, sf_dir):
    rows = records(spark, sf_dir)
    return bills.prior_notes_table(rows).select("id", "bill_key", "description", "date")


@query(f"""
WITH l AS ({LINES}), b AS (SELECT *, {BILL_KEY} AS bill_key, {STATUS} AS now FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {LINEITEM})),
ver AS (SELECT l.*, code FROM l JOIN {CODES} ON n = l_linenumber)
SELECT 'bill.created' AS type, bill_key, bill_key AS subject FROM b WHERE o_orderkey % 4 = 3
UNION ALL SELECT 'bill.status_changed', bill_key, now FROM b WHERE o_orderkey % 4 = 2 AND now <> 'introduced'
UNION ALL SELECT 'bill.version_added', bill_key, code FROM ver WHERE o_orderkey % 4 = 3 OR (o_orderkey % 4 = 2 AND l_linenumber = 3)
UNION ALL SELECT 'bill.amendment_added', bill_key, CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) FROM l WHERE o_orderkey % 4 = 3 AND l_returnflag = 'R'
UNION ALL SELECT 'hearing.scheduled', bill_key, bill_key || ':' || l_linenumber FROM l WHERE o_orderkey % 4 = 3
UNION ALL SELECT 'hearing.rescheduled', bill_key, bill_key || ':' || l_linenumber FROM l WHERE o_orderkey % 4 = 2
""")
def reload_events(spark, sf_dir):
    """A reload: of every four bills one is new, one changed its status, times and a version, one its hash alone, one is the same."""
    now = records(spark, sf_dir, held)
    k = F.col("bill_id") % 4
    earlier = now.where(k < 3).withColumn("change_hash", F.when(k > 0, "old").otherwise(F.col("change_hash"))).withColumn("status", F.when(k == 2, 1).otherwise(F.col("status")))
    moved = F.transform("calendar", lambda c: c.withField("location", F.lit("before")).withField("date", F.lit("1990-01-01")))
    earlier = earlier.withColumn("calendar", F.when(k == 2, moved).otherwise(F.col("calendar"))).withColumn("texts", F.when(k == 2, F.filter("texts", lambda t: t["doc_id"] != 3)).otherwise(F.col("texts")))
    return bills.reload(now, bills.tables(earlier), F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")), held)[1]


@query(f"""
SELECT bill_key, code AS version_code, CASE WHEN l_linenumber <= 2 THEN 'xml' WHEN l_linenumber <= 4 THEN 'htm' END AS format, CASE WHEN l_linenumber <= 4 THEN 'parsed' ELSE 'missing' END AS status
FROM ({LINES}) JOIN {CODES} ON n = l_linenumber
""")
def fetched_sources(spark, sf_dir):
    """Versions with their files: XML before HTM, else missing."""
    versions = held(bills.versions_table(records(spark, sf_dir)).select("bill_key", "version_code", "doc_id", "link"))
    files = versions.select(F.element_at(F.split("link", "/"), -1).alias("file_name"), F.lit("<x/>").alias("content"), F.col("doc_id")).distinct()
    xml = files.where("doc_id <= 2").drop("doc_id")
    htm = files.where("doc_id <= 4").select(F.replace("file_name", F.lit(".xml"), F.lit(".htm")).alias("file_name"), "content")
    return bills.fetched(versions, xml, htm).select("bill_key", "version_code", "format", "status")


@query(f"WITH v AS (SELECT bill_key, code, seq FROM ({LINES}) JOIN {CODES} ON n = l_linenumber) SELECT bill_key, max_by(code, seq) AS version_code, CAST(max(seq) + 1 AS INTEGER) AS next_version FROM v GROUP BY bill_key")
def latest_versions(spark, sf_dir):
    return op.latest_and_next(bills.versions_table(records(spark, sf_dir)), "bill_key", "version_code", "seq")


@query("""
SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'same' ELSE 'h' || c_custkey % 2 END AS digest, CASE WHEN c_custkey % 5 = 4 THEN 'done' WHEN c_custkey % 5 = 0 OR c_custkey % 3 <> 0 THEN 'pending' ELSE 'done' END AS status,
  CASE WHEN c_custkey % 5 = 4 OR c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'old' WHEN c_custkey % 2 = 1 THEN c_name END AS name
FROM (SELECT * FROM customer) WHERE NOT (c_custkey % 5 = 4 AND c_custkey % 3 <> 0)
""")
def requeue_changed(spark, sf_dir):
    """Customers as stored rows (four fifths) and as a reload that lacks one fifth of them; a third kept its digest."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    c = c.where(~((k % 5 == 4) & (k % 3 != 0)))
    old = c.where(k % 5 != 0).select(k.alias("key"), F.when(k % 3 == 0, "same").otherwise("old").alias("digest"), F.lit("done").alias("status"), F.lit("old").alias("name"))
    new = c.where(k % 5 != 4).select(k.alias("key"), F.when(k % 3 == 0, "same").otherwise(F.concat(F.lit("h"), k % 2)).alias("digest"), F.when(k % 2 == 1, F.col("c_name")).alias("name"))
    return op.requeue(old, new, "key", "digest", "status", ["name"])


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey >= 10 OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_unless(spark, sf_dir):
    keep = read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return op.delete_where(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("s_nationkey") < 10, keep, "s_nationkey")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM {LINEITEM} WHERE l_orderkey % 4 <> 0 OR l_orderkey NOT IN (SELECT l_orderkey FROM {LINEITEM} WHERE l_linenumber = 1) UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM {LINEITEM} WHERE l_orderkey % 4 = 0 AND l_linenumber = 1")
def reindex_groups(spark, sf_dir):
    index = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = index.where("l_orderkey % 4 = 0 AND l_linenumber = 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    return op.replace_group(index, fresh, "l_orderkey")


@query("""
SELECT p_partkey FROM part WHERE contains(lower(p_name), 'wid') AND p_size BETWEEN 10 AND 30 AND p_brand = 'Brand#11'
UNION ALL SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'PROMO') AND p_size >= 45
""")
def plain_filters(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("words", F.split("p_type", " "))
    one = p.where(op.all_of([op.contains_ignoring_case("p_name", "WiD"), op.within("p_size", 10, 30), op.equals("p_brand", "Brand#11"), op.equals("p_name", None), op.has("words", None)]))
    two = p.where(op.all_of([op.has("words", "PROMO"), op.within("p_size", 45, None)]))
    return one.select("p_partkey").unionAll(two.select("p_partkey"))


# Statutes that sections touch: a line's part as section of a chapter of a title.
CITE = "(l_suppkey % 40 + 1) || '.' || lpad(CAST(l_partkey % 30 AS VARCHAR), 2, '0') || '.' || lpad(CAST(l_partkey % 900 + 100 AS VARCHAR), 3, '0')"


def sections(spark, sf_dir):
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    cite = F.concat_ws(".", (F.col("l_suppkey") % 40 + 1).cast("string"), pad(F.col("l_partkey") % 30, 2), pad(F.col("l_partkey") % 900 + 100, 3))
    return lines(spark, sf_dir).select(
        F.concat(F.lit("b"), "l_orderkey").alias("bill_key"), F.lit("I").alias("version_code"), F.col("l_linenumber").cast("int").alias("ordinal"), F.concat(F.lit("sec-"), "l_linenumber").alias("section_id"), F.when(F.col("l_returnflag") != "N", cite).alias("cite"),
        F.when(F.col("l_returnflag") == "A", "amend").alias("action"), F.col("l_shipmode").alias("caption"), F.concat(F.lit("text "), "l_shipmode").alias("text"),
    )


@query(f"""
WITH s AS (SELECT 'b' || l_orderkey AS bill_key, l_linenumber AS n, {CITE} AS cite, CASE WHEN l_returnflag = 'A' THEN 'amend' ELSE 'new' END AS action, l_shipmode FROM {LINEITEM} WHERE l_returnflag <> 'N')
SELECT bill_key, action, cite, regexp_extract(cite, '^[0-9]+[.][0-9]+') AS chapter, split_part(cite, '.', 1) AS title, string_agg('sec-' || n, ',' ORDER BY n) AS sections, min_by(l_shipmode, n) AS caption FROM s GROUP BY ALL
""")
def statutes_affected(spark, sf_dir):
    return bill_ops.affected_statutes(sections(spark, sf_dir)).select("bill_key", "action", "cite", "chapter", "title", F.array_join("section_ids", ",").alias("sections"), "caption")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey % 7 * 10 AS seq FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey, o_orderkey % 11 * 10 AS note_seq, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus <> 'P'),
q AS (SELECT DISTINCT o_custkey, seq FROM r), j AS (SELECT q.*, note_seq, o_orderdate, o_orderkey FROM q LEFT JOIN n ON q.o_custkey = n.o_custkey AND note_seq <= seq)
SELECT CAST(o_custkey AS VARCHAR) AS bill_key, seq, arg AS note_id FROM (
  SELECT o_custkey, seq, first(CAST(o_orderkey AS VARCHAR) ORDER BY note_seq DESC NULLS LAST, o_orderdate DESC NULLS LAST, CAST(o_orderkey AS VARCHAR)) AS arg FROM j GROUP BY ALL)
WHERE arg IS NOT NULL
""")
def notes_of_versions(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    asked = o.where(k % 2 == 0).select(F.col("o_custkey").cast("string").alias("bill_key"), (k % 7 * 10).alias("seq")).distinct()
    published = o.where(k % 2 == 1).select(F.col("o_custkey").cast("string").alias("bill_key"), (k % 11 * 10).alias("note_seq"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"), k.cast("string").alias("note_id"))
    return bill_ops.note_for_version(asked, published).select("bill_key", "seq", "note_id").where("note_id IS NOT NULL")


@query("""
SELECT p_partkey, 'fish ' || p_size AS subject, CASE WHEN p_size % 4 = 0 THEN 'amending,adding-chapter,emergency' WHEN p_size % 4 = 1 THEN 'reenacting-and-amending,amending,other' WHEN p_size % 4 = 2 THEN 'creating-new-sections,expiration' ELSE '' END AS kinds,
  CASE WHEN p_size % 4 < 2 THEN '77.' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.010' ELSE '' END AS cites FROM part
""")
def bill_titles(spark, sf_dir):
    k, cite = F.col("p_size") % 4, F.concat(F.lit("77."), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".010"))
    tail = F.when(k == 0, F.concat(F.lit("; amending RCW "), cite, F.lit("; adding a new chapter to Title 77 RCW; and declaring an emergency."))).when(k == 1, F.concat(F.lit(";  reenacting and amending RCW "), cite, F.lit("; amending chapter 5, 1996 Laws; and prescribing penalties."))).when(k == 2, "; creating new sections; and providing an expiration date.").otherwise(".")
    title = F.concat(F.lit("AN ACT Relating to fish "), "p_size", tail)
    got = read(spark, sf_dir, "part").select("p_partkey", clauses.title_actions(title).alias("t"))
    first = F.coalesce(F.get(F.get("t.actions", F.lit(0))["cites"], F.lit(0)), F.lit(""))
    return got.select("p_partkey", "t.subject", F.array_join(F.transform("t.actions", lambda a: a["kind"]), ",").alias("kinds"), first.alias("cites"))


KIND_TEXT = ["This act is necessary for the immediate preservation of the public peace", "If any is held invalid, the remainder is not affected", "Section 1 expires on the last day of this act", "takes effect only if it is funded", "The sum of $5 is granted", "The legislature finds that", "Expiring parts of these acts, iffy effects, sums"]


@query(f"SELECT l_orderkey, l_linenumber, (['emergency', 'severability', 'expiration', 'contingent', 'appropriation', 'intent', 'new'])[(l_linenumber - 1) % 7 + 1] AS kind FROM {LINEITEM}")
def section_kinds(spark, sf_dir):
    prose = F.concat(F.element_at(F.array(*map(F.lit, KIND_TEXT)), (F.col("l_linenumber") - 1) % 7 + 1), F.lit(" "), F.col("l_shipmode"))
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", clauses.section_kind_column(prose).alias("kind"))


AMOUNT = "(CASE l_linenumber % 4 WHEN 0 THEN -l_extendedprice WHEN 1 THEN l_extendedprice * 100 ELSE l_quantity END)"


@query(f"""
WITH a AS (SELECT l_orderkey, l_linenumber, {AMOUNT} AS v, CAST(floor(abs({AMOUNT}) + 0.5) AS BIGINT) AS w, CAST(floor(abs({AMOUNT}) / 1000 + 0.5) AS BIGINT) AS k FROM {LINEITEM})
SELECT l_orderkey, l_linenumber, CASE WHEN v < 0 THEN '(' || format('{{:,}}', w) || ')' ELSE format('{{:,}}', w) END AS money, CASE WHEN v < 0 THEN '($' || format('{{:,}}', w) || ')' ELSE '$' || format('{{:,}}', w) END AS dollars,
  CASE WHEN v < 0 THEN '-' || format('{{:,}}', w) ELSE format('{{:,}}', w) END AS whole, '$' || format('{{:,}}', k) || ',000' AS thousands, CASE WHEN v = 0 THEN 'does not change' WHEN v < 0 THEN 'decreases' ELSE 'increases' END AS direction FROM a
""")
def shown_amounts(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    v = F.when(n == 0, -F.col("l_extendedprice")).when(n == 1, F.col("l_extendedprice") * 100).otherwise(F.col("l_quantity")).cast("double")
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", v.alias("v"))
    kinds = {"money": "money", "dollars": "money-thousands", "whole": "int"}
    return rows.select("l_orderkey", "l_linenumber", *[text.format_column(F.col("v"), k).alias(c) for c, k in kinds.items()], text.thousands(F.col("v")).alias("thousands"), text.direction(F.col("v")).alias("direction"))


@query("""
SELECT p_partkey, '"' || substr(sha256(p_name), 1, 24) || '"' AS etag, CASE p_size % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'chapter' ELSE 'cite' END AS level, CASE p_size % 3 WHEN 0 THEN NULL ELSE p_size || '.04' END AS chapter,
  replace(replace(replace(p_name || ' <&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM part
""")
def text_scalars(spark, sf_dir):
    size = F.col("p_size").cast("string")
    cite = F.when(F.col("p_size") % 3 == 0, size).when(F.col("p_size") % 3 == 1, F.concat(size, F.lit(".04"))).otherwise(F.concat(size, F.lit(".04.010")))
    return read(spark, sf_dir, "part").select("p_partkey", text.etag(F.col("p_name")).alias("etag"), text.cite_level(cite).alias("level"), text.cite_chapter(cite).alias("chapter"), text.escape_html(F.concat("p_name", F.lit(" <&>"))).alias("escaped"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS iso, (CAST(year(o_orderdate) - (year(o_orderdate) + 1) % 2 AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) - (year(o_orderdate) + 1) % 2 + 1) % 100 AS VARCHAR), 2, '0')) AS biennium,
  strftime(o_orderdate - INTERVAL 1 DAY, '%B %-d, %Y') AS published, o_orderkey % 2 = 0 AS adopted, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS adopted_on FROM orders
""")
def time_scalars(spark, sf_dir):
    """Midnight in UTC is the day before in Pacific time, whatever the clocks say."""
    at, even = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 2 == 0
    action = text.floor_action(F.when(even, F.concat(F.lit("Adopted "), F.date_format("o_orderdate", "MM/dd/yyyy"))).otherwise("NOT ADOPTED"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", text.iso_millis(at).alias("iso"), text.biennium_column(F.year("o_orderdate")).alias("biennium"), text.published_date(at).alias("published"), action.alias("a"))
    return rows.select("o_orderkey", "iso", "biennium", "published", "a.adopted", F.col("a.date").alias("adopted_on"))


# A note of each order: a table of accounts from its lines, with a total, staff and objects that are right or not by the order's key.
def note_docs(spark, sf_dir):
    cell = lambda i, v: F.struct(F.lit("noteCell").alias("type"), F.struct(F.concat(F.lit("fy"), i).alias("col"), v.cast("double").alias("value")).alias("attrs"))
    row = lambda kind, key, cells: F.struct(F.lit("noteRow").alias("type"), F.struct(F.lit(kind).alias("rowKind"), key.cast("string").alias("key")).alias("attrs"), cells.alias("content"))
    table = lambda role, rows: F.struct(F.lit("noteTable").alias("type"), F.struct(F.lit(role).alias("role")).alias("attrs"), rows.alias("content"))
    # Lines are dealt out once, as an order has too few in a file to gather them before, and put in order within their note.
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", *ORDERED).repartition("l_orderkey")
    own = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*ORDERED))).alias("x"))
    k, n, q = F.col("l_orderkey"), lambda i: i + 1, lambda r: r["l_quantity"].cast("double")
    accounts = F.transform("x", lambda r, i: row("account", n(i), F.array(cell(n(i), q(r)))))
    extra = F.array(row("total", F.lit("t"), F.array(cell(F.lit(1), q(F.get("x", F.lit(0))) + F.when(k % 3 == 0, 2.0).otherwise(0.25)))), row("fte", F.lit("f"), F.array(cell(F.lit(2), F.lit(1.0)))))
    objects = F.transform("x", lambda r, i: row("object", n(i), F.array(cell(n(i), q(r) + F.when((k % 4 == 0) & (n(i) == 2), 5.0).otherwise(0.0)))))
    classes = F.array(row("class", F.lit("c"), F.array(cell(F.lit(2), F.when(k % 5 == 0, 2.0).otherwise(1.0)))))
    doc = F.struct(F.lit("doc").alias("type"), F.array(table(estimate.ACCOUNTS, F.concat(accounts, extra)), table(estimate.OBJECTS, objects), table(estimate.CLASSES, classes)).alias("content"))
    return own.select(k.cast("string").alias("id"), F.to_json(doc).alias("doc"))


@query(f"""
WITH q AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q FROM {LINEITEM})
SELECT CAST(k AS VARCHAR) AS doc_id, 'total' AS rule, 1 AS fy, sum(CASE WHEN n = 1 THEN q ELSE 0 END) + 2 AS stated, sum(CASE WHEN n = 1 THEN q ELSE 0 END) AS summed FROM q WHERE k % 3 = 0 GROUP BY k
UNION ALL SELECT CAST(k AS VARCHAR), 'object', 2, q, q + 5 FROM q WHERE k % 4 = 0 AND n = 2
UNION ALL SELECT CAST(k AS VARCHAR), 'staff', 2, 1, 2 FROM q WHERE k % 5 = 0 GROUP BY k
""")
def note_rules(spark, sf_dir):
    facts = held(estimate.fact_table(note_docs(spark, sf_dir), "id", "doc"))
    parts = {"total": estimate.total_errors(facts), "object": estimate.object_errors(facts), "staff": estimate.staff_errors(facts)}
    out = [df.select("doc_id", F.lit(rule).alias("rule"), "fy", "stated", "summed") for rule, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""
WITH q AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q FROM {LINEITEM})
SELECT doc_id, '{estimate.ACCOUNTS}' AS part, CAST(n AS VARCHAR) AS row_key, CAST(ceil(n / 2) AS INTEGER) AS bien, q AS value FROM q
UNION ALL SELECT doc_id, '{estimate.OBJECTS}', CAST(n AS VARCHAR), CAST(ceil(n / 2) AS INTEGER), q + CASE WHEN k % 4 = 0 AND n = 2 THEN 5 ELSE 0 END FROM q
UNION ALL SELECT doc_id, '{estimate.CLASSES}', 'c', 1, CASE WHEN k % 5 = 0 THEN 1 ELSE 0.5 END FROM q GROUP BY doc_id, k
""")
def note_biennia(spark, sf_dir):
    """Fiscal years summed in pairs; staff is an average."""
    sums = estimate.document_biennia(note_docs(spark, sf_dir), "id", "doc").where("row_kind IN ('account', 'object', 'class')")
    return sums.select("doc_id", "part", "row_key", "bien", "value")


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber AS VARCHAR) AS row_key, CAST(l_quantity AS DOUBLE) AS total FROM {LINEITEM} WHERE l_linenumber <= 10")
def note_ten_years(spark, sf_dir):
    """Sums over the ten fiscal years; a note's lines stand for years, and those beyond the tenth aren't in the table."""
    facts = estimate.fact_table(note_docs(spark, sf_dir), "id", "doc").where(f"row_kind = 'account' AND part = '{estimate.ACCOUNTS}'")
    return estimate.ten_year(facts).select("doc_id", "row_key", "total")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority || ' ' || o_orderstatus AS text, CAST(length(o_orderpriority) + 1 AS BIGINT) AS place, CAST(4 AS BIGINT) AS nodes FROM orders")
def note_text(spark, sf_dir):
    """Text of a small document of each order, and where its comment stands."""
    leaf = lambda value, mark: F.struct(F.lit("text").alias("type"), F.struct(mark.alias("comment")).alias("attrs"), value.alias("text"))
    null = F.lit(None).cast("string")
    body = F.struct(F.lit("p").alias("type"), F.array(leaf(F.concat("o_orderpriority", F.lit(" ")), null), leaf(F.col("o_orderstatus"), F.lit("c1"))).alias("content"))
    docs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.to_json(F.struct(F.lit("doc").alias("type"), F.array(body).alias("content"))).alias("doc"))
    nodes = estimate.flatten(docs, "id", "doc")
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"))
    # Two nodes without text stand before the first one and count one each.
    places = estimate.comment_places(nodes).select("key", (F.col("at") - 2).cast("long").alias("place"))
    return estimate.document_text(nodes).join(places, "key").join(sizes, "key")


@query("""
WITH s AS (SELECT c_custkey, c_custkey % 5 AS r, (['draft', 'in_review', 'changes_requested', 'approved', 'published'])[c_nationkey % 5 + 1] AS state, c_custkey % 7 = 0 AS own, c_custkey % 11 = 0 AS part FROM customer),
p AS (SELECT *, r = 0 AS admin, r IN (1, 2) AS reviewer, r IN (2, 3) AS drafter FROM s), v AS (SELECT *, admin OR reviewer OR state = 'published' OR (drafter AND (own OR part)) AS reads FROM p)
SELECT c_custkey, reads AS can_read, reads AND (admin OR reviewer OR drafter) AS can_comment, state IN ('draft', 'changes_requested') AND own AS can_edit, state = 'in_review' AND reviewer AND NOT own AS can_review, state = 'approved' AND reviewer AND NOT own AS can_publish FROM v
""")
def permissions(spark, sf_dir):
    k = F.col("c_custkey")
    roles = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in (["admin"], ["reviewer"], ["reviewer", "drafter"], ["drafter"], ["viewer"])]), (k % 5 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, workflow.STATES)), (F.col("c_nationkey") % 5 + 1).cast("int"))
    order = F.when(F.col("c_nationkey") % 5 == 2, "changes_requested").otherwise(state)
    user, drafter, parts = k.cast("string"), F.when(k % 7 == 0, k.cast("string")), F.when(k % 11 == 0, F.array(k.cast("string")))
    rows = read(spark, sf_dir, "customer")
    allowed = lambda action: workflow.can(f"note.{action}", roles, user, order, drafter, None, parts).alias(f"can_{action}")
    return rows.select("c_custkey", *[allowed(a) for a in ("read", "comment", "edit", "review", "publish")])


@query("""
WITH s AS (SELECT *, (['draft', 'approved', 'published'])[o_orderkey % 3 + 1] AS state, o_orderkey % 2 = 0 AS part, 3 AS head, CASE WHEN o_orderkey % 3 > 0 THEN 1 END AS approved, CASE WHEN o_orderkey % 3 = 2 THEN 2 END AS published, CASE WHEN o_custkey % 4 = 0 THEN 1 END AS asked FROM orders)
SELECT o_orderkey, CASE WHEN NOT part AND state <> 'published' THEN 404 WHEN NOT part AND asked = 1 THEN 403 ELSE 200 END AS status,
  CASE WHEN part THEN coalesce(asked, published, approved, head) WHEN state = 'published' AND asked IS NULL THEN published END AS version FROM s
""")
def export_versions(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    state = F.element_at(F.array(F.lit("draft"), F.lit("approved"), F.lit("published")), (k + 1).cast("int"))
    roles = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("drafter"))).otherwise(F.array(F.lit("viewer")))
    x = notes.export_version(roles, state, F.when(k > 0, 1), F.when(k == 2, 2), F.when(F.col("o_custkey") % 4 == 0, 1), F.lit(3))
    return read(spark, sf_dir, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", "x.status", "x.version")


FEED = "SELECT o_orderkey AS note_revision_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.000' AS published, c_name AS publisher FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"


@query(f"SELECT note_revision_id, published, coalesce(publisher, 'System') AS publisher FROM ({FEED}) WHERE (published, note_revision_id) < ('1997-01-01 00:00:00.000', 5000) ORDER BY published DESC, note_revision_id DESC LIMIT 201")
def published_page(spark, sf_dir):
    """A page of the feed after a cursor; a page is of 200 rows at most, whatever is asked for."""
    o = read(spark, sf_dir, "orders")
    revisions = o.select(F.col("o_orderkey").alias("note_revision_id"), F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("published_by"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"))
    n = o.select(F.col("o_orderkey").alias("note_id"), F.lit("b").alias("bill_key"), F.lit("I").alias("version_code"))
    bill = n.limit(1).select("bill_key", F.lit("T").alias("title"))
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    cursor = notes.encode_cursor("1997-01-01 00:00:00.000", "5000")
    return notes.published_feed(revisions, n, bill, bill.select("bill_key", F.lit("I").alias("version_code"), F.lit("HB 1").alias("label")), users, 1000, cursor).select("note_revision_id", F.col("at").alias("published"), "publisher")


WORDS = f"(SELECT doc_id, {TOKENS} AS ws FROM documents)"


@query(f"SELECT doc_id FROM {WORDS} WHERE (list_has_any(ws, ['idiot', 'idiots']) AND NOT list_has_any(ws, ['clown', 'clowns'])) OR list_has_any(ws, ['moron', 'morons'])")
def search_words(spark, sf_dir):
    """A web-style query over stems: one word without another, or a third."""
    tree = search.parse_query("idiot -clown OR Morons")
    docs = search.analyse(read(spark, sf_dir, "documents").select("doc_id", "text"), {"text": "D"}, only=search.all_terms(tree))
    return docs.where(search.matches(tree, F.col("terms"))).select("doc_id")


@query(f"SELECT doc_id, 0.1 * n / (0.1 * n + 1) AS rank FROM (SELECT doc_id, len(list_filter(ws, lambda w: w IN ('idiot', 'idiots'))) AS n FROM {WORDS}) WHERE n > 0")
def search_rank(spark, sf_dir):
    """Cover density of one word: each place is a stretch of its own, of the weight of its field."""
    tree = search.parse_query("idiots")
    docs = search.analyse(read(spark, sf_dir, "documents").select("doc_id", "text"), {"text": "D"}, only=search.all_terms(tree))
    return search.ranked(docs, tree).select("doc_id", "rank")


def section(code, n, identity, kind, text):
    return F.struct(F.lit(code).alias("version_code"), n.alias("ordinal"), identity.alias("identity"), n.alias("num"), F.lit(kind).alias("kind"), text.alias("text"))


def sections_of(rows, *sections):
    """The sections that each line makes, from one reading of the lines."""
    made = rows.select(F.concat(F.lit("b"), "l_orderkey").alias("bill_key"), F.explode(F.array(*sections)).alias("s"))
    return made.where("s IS NOT NULL").select("bill_key", "s.*")


@query(f"""
WITH p AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS q, l_linenumber % 5 = 0 AS gone, l_linenumber = 2 AS edited FROM {LINEITEM})
SELECT 'b' || l_orderkey AS bill_key, 'id' || n AS identity, CASE WHEN gone THEN 'removed' WHEN edited THEN 'changed' ELSE 'equal' END AS status FROM p
UNION ALL SELECT 'b' || l_orderkey, 'new', 'added' FROM p WHERE n = 1
""")
def version_diffs(spark, sf_dir):
    """Two versions of every order's lines as sections: each fifth is gone, the second is edited, one is new."""
    n = F.col("l_linenumber").cast("int")
    text = F.concat(F.lit("w"), n, F.lit(" of "), "l_quantity")
    before = section("I", n, F.concat(F.lit("id"), n), "k", text)
    after = F.when(n % 5 != 0, section("S", n, F.concat(F.lit("id"), n), "k", F.when(n == 2, F.concat(text, F.lit(" more"))).otherwise(text)))
    fresh = F.when(n == 1, section("S", F.lit(9), F.lit("new"), "other", F.lit("something else entirely here")))
    every = sections_of(lines(spark, sf_dir), before, after, fresh).withColumn("text_hash", F.md5("text"))
    return diff.diff_versions(every, "I", "S").select("bill_key", "identity", "status")


@query("""
WITH t AS (SELECT p_partkey AS id, sha256(p_name) AS a, sha256(CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END) AS b FROM part)
SELECT CAST(id AS VARCHAR) AS id, 1 AS version, a AS digest, a = b AS current FROM t UNION ALL SELECT CAST(id AS VARCHAR), 2, b, true FROM t WHERE a <> b
""")
def template_history(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("html"), "p_partkey")
    stored = spark.createDataFrame([], "id string, version int, digest string, html string")
    one = bill_ops.template_versions(stored, part.drop("p_partkey")).drop("current")
    changed = part.select("id", F.when(F.col("p_partkey") % 3 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("html"))
    return bill_ops.template_versions(one, changed).select("id", "version", "digest", "current")


@query("""
WITH c AS (SELECT l_orderkey AS note_id, l_orderkey * 100 + l_linenumber AS comment_id, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END AS pos FROM {LINEITEM})
SELECT note_id, comment_id, CAST(row_number() OVER (PARTITION BY note_id ORDER BY pos NULLS LAST, comment_id) AS INTEGER) AS place, CASE WHEN comment_id % 2 = 0 THEN 'one,two' ELSE '' END AS said FROM c
""".replace("{LINEITEM}", LINEITEM))
def comment_threads(spark, sf_dir):
    """Lines as comments on their order's note, every second with two messages."""
    comments = line_comments(spark, sf_dir)
    said = comments.where(F.col("comment_id") % 2 == 0).select("comment_id", F.explode(F.array(F.struct(F.lit(2).alias("at"), F.lit("two").alias("body")), F.struct(F.lit(1).alias("at"), F.lit("one").alias("body")))).alias("m"))
    messages = said.select("comment_id", "m.at", F.concat_ws("-", "comment_id", "m.at").alias("message_id"), "m.body")
    return notes.threads(comments, messages).select("note_id", "comment_id", "place", F.array_join(F.transform("messages", lambda m: m["body"]), ",").alias("said"))


def line_comments(spark, sf_dir):
    n = F.col("l_linenumber")
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("note_id"), (F.col("l_orderkey") * 100 + n).alias("comment_id"), F.when(n % 3 > 0, F.col("l_partkey")).alias("pos"), F.when(F.col("l_returnflag") == "R", "open").otherwise("resolved").alias("status"))


@query(f"SELECT l_orderkey AS note_id, count(*) FILTER (l_returnflag = 'R') AS open FROM {LINEITEM} GROUP BY 1")
def open_threads(spark, sf_dir):
    return notes.open_threads(line_comments(spark, sf_dir))


@query(f"SELECT 'b' || l_suppkey AS bill_key, l_returnflag AS version_code, 'sec-' || l_linenumber AS section_id, count(*) AS n FROM {LINEITEM} GROUP BY ALL")
def annotation_counts(spark, sf_dir):
    return notes.counts_by_section(lines(spark, sf_dir).select(F.concat(F.lit("b"), "l_suppkey").alias("bill_key"), F.col("l_returnflag").alias("version_code"), F.concat(F.lit("sec-"), "l_linenumber").alias("section_id")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE CAST(o_orderkey % 4 AS INTEGER) END AS n_errors, coalesce(c_name, 'System') AS author FROM orders LEFT JOIN customer ON CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END = c_custkey")
def version_errors(spark, sf_dir):
    """Numbers of errors of every order, three in four of which have a list of them, and who wrote it."""
    k = F.col("o_orderkey")
    versions = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 > 0, F.col("o_custkey")).alias("author_id"), F.when(k % 4 < 3, F.slice(F.array(F.lit("a"), F.lit("b")), 1, (k % 4).cast("int"))).alias("errors"))
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return notes.with_people(notes.error_counts(versions), "author_id", users, "author").select("o_orderkey", "n_errors", "author")


@query("SELECT state, count(*) AS n, CAST(nullif(list_position(['draft', 'in_review', 'changes_requested', 'approved', 'published'], state), 0) AS INTEGER) AS place FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'in_review' END AS state FROM orders) GROUP BY state")
def notes_by_status(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("in_review")
    return notes.by_status(read(spark, sf_dir, "orders").select(state.alias("state")))


@query("SELECT event_id AS seq, event_type FROM events WHERE CAST(user_id AS VARCHAR) = '7' AND event_id < 900000 ORDER BY seq DESC LIMIT 500")
def transition_history(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instance_id"), F.col("event_id").alias("seq"), "event_type")
    return notes.history_page(log, "7", 900_000, 10_000).select("seq", "event_type")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN 'dev-' ELSE 'u-' END || c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'seed' ELSE c_name END AS name FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0")
def seed_users(spark, sf_dir):
    k = F.col("c_custkey")
    users = read(spark, sf_dir, "customer").select(F.concat(F.when(k % 2 == 0, "dev-").otherwise("u-"), k).alias("user_id"), F.col("c_name").alias("name"), k.alias("k"))
    seeds = users.where("k % 3 = 0").select("user_id", F.lit("seed").alias("name"))
    return notes.seeded_users(users.drop("k"), seeds)


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 1 OR o_orderkey % 7 = 2
""")
def sponsor_filter(spark, sf_dir):
    """Bills of one sponsor by last name or part of a name, and of another by number."""
    k = F.col("o_orderkey")
    who = F.struct((k % 7).cast("long").alias("people_id"), F.when(k % 6 == 1, "Ann Lee").otherwise("Bo Ray").alias("name"), F.when(k % 6 == 1, "Lee").otherwise("Ray").alias("last_name"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.array(who).alias("sponsors"))
    one = rows.where(op.all_of([op.sponsored("sponsors", "LEE"), op.sponsored("sponsors", "nn le"), op.sponsored("sponsors", None)]))
    return one.unionByName(rows.where(op.sponsored("sponsors", 2))).select("o_orderkey").distinct()


@query("SELECT p_partkey FROM part WHERE (p_size % 2 = 0 OR p_size % 3 = 0) AND (contains(lower(p_name), 'wid') OR contains(lower(p_type), 'wid') OR contains(lower(p_brand), 'wid'))")
def template_filter(spark, sf_dir):
    """Parts as templates: a tag with its prefix or bare, and free text over name, type and brand."""
    tags = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("tax:sales"))).when(F.col("p_size") % 3 == 0, F.array(F.lit("sales"), F.lit("x")))
    rows = read(spark, sf_dir, "part").withColumn("tags", tags)
    return rows.where(op.all_of([op.tagged("tags", "tax", "sales"), op.tagged("tags", "impact", None), op.any_contains(["p_name", "p_type", "p_brand"], "WID")])).select("p_partkey")


@query("""
WITH h AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice * 1.5 FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT id, max(score) AS score FROM h GROUP BY id ORDER BY score DESC, id LIMIT 40
""")
def merged_search(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderstatus", "o_orderpriority")
    hits = [o.where("o_orderstatus = 'F'").select("id", "score"), o.where("o_orderpriority = '1-URGENT'").select("id", (F.col("score") * 1.5).alias("score"))]
    return op.merged_hits(hits, "score", "id", 40)


@query("SELECT p_partkey, '<mark>' || p_name || '</mark> &lt;b&gt; &amp;' AS headline, p_brand || '||' || p_size AS key FROM part")
def safe_headlines(spark, sf_dir):
    shown = text.safe_headline(F.concat(F.lit("<mark>"), "p_name", F.lit("</mark> <b> &")))
    return read(spark, sf_dir, "part").select("p_partkey", shown.alias("headline"), notes.cite_key(F.col("p_brand"), F.lit(None), F.col("p_size")).alias("key"))


@query(f"""
WITH e AS (SELECT o_orderkey % 4 AS k, {STATUS} AS now, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), l AS (SELECT l_orderkey % 4 AS k, * FROM {LINEITEM} WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
c AS (SELECT (SELECT count(*) FROM e WHERE k = 3) AS created, (SELECT count(*) FROM e WHERE k = 2 AND now <> 'introduced') AS changed, (SELECT count(*) FROM l WHERE k = 3 OR (k = 2 AND l_linenumber = 3)) AS versions, (SELECT count(*) FROM l WHERE k = 3 AND l_returnflag = 'R') AS amendments, (SELECT count(*) FROM l WHERE k >= 2) AS hearings)
SELECT *, created + changed + versions + amendments + hearings AS events FROM c
""")
def reload_counters(spark, sf_dir):
    """The counters of the reload that `reload_events` lists."""
    return notes.ingest_counters(reload_events(spark, sf_dir))


LEVELLED = "CASE l_linenumber % 3 WHEN 0 THEN CAST(l_suppkey % 4 + 1 AS VARCHAR) WHEN 1 THEN (l_suppkey % 4 + 1) || '.' || l_partkey % 3 ELSE (l_suppkey % 4 + 1) || '.' || l_partkey % 3 || '.' || l_partkey % 50 END"


@query(f"""
WITH l AS (SELECT 'b' || l_orderkey % 200 AS bill_key, *, {LEVELLED} AS cite FROM {LINEITEM}), c AS (SELECT DISTINCT bill_key, cite FROM l),
s AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.bill_key = c.bill_key AND starts_with(d.cite, c.cite || '.'))),
a AS (SELECT bill_key, CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) AS id, l_shipdate AS date, l_returnflag = 'R' AS amends FROM l)
SELECT bill_key, 'amendment' AS kind, id, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY bill_key ORDER BY date DESC, id) AS n FROM a WHERE amends) WHERE n <= 20
UNION ALL SELECT bill_key, 'note', id, CAST(n AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY bill_key ORDER BY date DESC, id) AS n FROM a WHERE NOT amends) WHERE n <= 10
UNION ALL SELECT DISTINCT bill_key, 'companion', 'SB' || bill_key, 1 FROM l WHERE l_orderkey % 200 < 50
UNION ALL SELECT bill_key, 'statute', cite, CAST(row_number() OVER (PARTITION BY bill_key ORDER BY array_to_string(list_transform(string_split(cite, '.'), lambda p: lpad(p, 6, '0')), '.'), cite) AS INTEGER) FROM s
""")
def related_items(spark, sf_dir):
    """Lines as amendments, notes and statutes of two hundred bills."""
    part = lambda n: F.when(n == 0, F.concat_ws(".", F.col("l_suppkey") % 4 + 1)).when(n == 1, F.concat_ws(".", F.col("l_suppkey") % 4 + 1, F.col("l_partkey") % 3)).otherwise(F.concat_ws(".", F.col("l_suppkey") % 4 + 1, F.col("l_partkey") % 3, F.col("l_partkey") % 50))
    rows = lines(spark, sf_dir).select(F.concat(F.lit("b"), F.col("l_orderkey") % 200).alias("bill_key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("date"), (F.col("l_returnflag") == "R").alias("amends"), part(F.col("l_linenumber") % 3).alias("cite"), (F.col("l_orderkey") % 200 < 50).alias("pair"))
    companions = rows.select("bill_key", F.when(F.col("pair"), F.concat(F.lit("SB"), "bill_key")).alias("companion")).distinct()
    return search.related(companions, rows.where("amends"), rows.where("NOT amends"), rows)


@query("SELECT 'b' || l_orderkey AS bill_key, l_linenumber AS n, CASE WHEN l_orderkey % 4 = 1 THEN 'new' ELSE 'old' END AS body FROM {LINEITEM} WHERE l_orderkey % 4 <> 2".replace("{LINEITEM}", LINEITEM))
def reindex_events(spark, sf_dir):
    """Events name half of all bills; of those, the index is rebuilt for one half and lost for the other."""
    index = lines(spark, sf_dir).select(F.concat(F.lit("b"), "l_orderkey").alias("bill_key"), F.col("l_linenumber").alias("n"), F.lit("old").alias("body"), (F.col("l_orderkey") % 4).alias("k"))
    events = index.where("k IN (1, 2)").select("bill_key")
    return search.reindexed(index.drop("k"), events, index.where("k IN (0, 1)").drop("k").withColumn("body", F.lit("new")))


# Where what is heard is held, by line number, and the committee that it names.
PLACES = [("House Committee on Ways & Means", "H", "Ways & Means"), ("senate  committee on Law", "S", "Law"), ("Joint Committee on Energy", None, "Energy"), ("House Committee on", None, "House Committee on"), (" Hearing Room 4 ", None, "Hearing Room 4")]


@query(f"""
SELECT l_orderkey, l_linenumber, [{", ".join("NULL" if c is None else f"'{c}'" for _, c, _ in PLACES)}][l_linenumber % 5 + 1] AS chamber, [{", ".join(f"'{c}'" for _, _, c in PLACES)}][l_linenumber % 5 + 1] AS committee,
  CASE l_linenumber % 4 WHEN 0 THEN '2SHB ' || (l_orderkey % 900 + 1000) WHEN 1 THEN 'EHB ' || (l_orderkey % 900 + 1000) ELSE 'about (' || l_suppkey || ')' || CASE l_linenumber % 4 WHEN 3 THEN '' ELSE ' fish' END END AS label,
  CASE l_linenumber % 4 WHEN 0 THEN 'Final' WHEN 1 THEN NULL WHEN 2 THEN 'Partial' END AS kind
FROM {LINEITEM}
""")
def hearing_labels(spark, sf_dir):
    """Committees of hearings, and labels of prior notes: of a bill's version, of a kind, of parentheses that say nothing."""
    n = F.col("l_linenumber") % 4
    number = (F.col("l_orderkey") % 900 + 1000).cast("string")
    about = F.concat(F.lit("about ("), "l_suppkey", F.lit(")"))
    told = F.when(n == 0, F.concat(number, F.lit(" 2S HB (FINAL)"))).when(n == 1, F.concat(F.lit("engrossed house bill "), number)).when(n == 2, F.concat(about, F.lit(" fish (partial) "))).otherwise(about)
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", bills.committee_of(F.element_at(F.array(*[F.lit(p) for p, _, _ in PLACES]), F.col("l_linenumber") % 5 + 1)).alias("c"), bills.note_label(told, "2025-26").alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "c.chamber", "c.committee", "x.label", "x.kind")


@query(f"""
WITH v AS (SELECT *, seq % 100 // 10 AS s, seq % 10 AS e FROM ({LINES}) JOIN {CODES} ON n = l_linenumber),
w AS (SELECT *, CASE WHEN e > 1 THEN e || 'E' WHEN e = 1 THEN 'E' ELSE '' END AS ee, CASE WHEN s > 1 THEN s || 'S' WHEN s = 1 THEN 'S' ELSE '' END AS ss, CASE WHEN o_orderkey % 2 = 0 THEN 'HB' ELSE 'SJR' END AS t,
  CASE seq // 100 WHEN 1 THEN 'PL' WHEN 2 THEN 'SL' ELSE '' END AS stage, CASE WHEN o_orderkey % 2 = 0 THEN 'House' ELSE 'Senate' END AS house FROM v)
SELECT bill_key, code AS version_code, ee || ss || t || ' ' || o_orderkey || CASE WHEN stage = '' THEN '' ELSE ' (' || stage || ')' END AS short, concat_ws(' ', CAST(o_orderkey AS VARCHAR), nullif(ee, ''), nullif(ss, ''), t, nullif(stage, '')) AS listed,
  CASE WHEN s > 0 THEN '-S' || CASE WHEN s > 1 THEN CAST(s AS VARCHAR) ELSE '' END ELSE '' END || CASE WHEN stage <> '' THEN '.' || stage WHEN e > 1 THEN '.E' || e WHEN e = 1 THEN '.E' ELSE '' END AS suffix,
  CASE stage WHEN 'SL' THEN 'Session%20Laws/' || house WHEN 'PL' THEN house || '%20Passed%20Legislature' ELSE CASE WHEN t = 'HB' THEN 'House%20Bills' ELSE 'Senate%20Joint%20Resolutions' END END AS folder
FROM w
""")
def version_labels(spark, sf_dir):
    """Labels, listed numbers, file suffixes and folders of all versions."""
    v = bills.versions_table(records(spark, sf_dir)).select("bill_key", "version_code")
    bill = F.substring_index("bill_key", ":", -1)
    kind = F.rtrim(bill, F.lit("0123456789"))
    got = v.withColumn("x", refs.labels_column(kind, F.substr(bill, F.length(kind) + 1).cast("int"), F.col("version_code"), F.split_part("bill_key", F.lit(":"), F.lit(2))))
    return got.select("bill_key", "version_code", "x.short", "x.listed", "x.suffix", F.regexp_extract("x.url", r"/Xml/Bills/(.*)/", 1).alias("folder"))


def section_versions(spark, sf_dir):
    """Every order's lines as sections of two versions: each fifth is gone, the second is edited, one is new."""
    n = F.col("l_linenumber").cast("int")
    text = F.concat(F.lit("w"), n, F.lit(" of "), "l_quantity", F.lit("\nplain ground"))
    before = section("I", n, F.concat(F.lit("id"), n), "k", text)
    after = F.when(n % 5 != 0, section("S", n, F.concat(F.lit("id"), n), "k", F.when(n == 2, F.concat(F.lit("ahead of all\n"), text, F.lit(" more"))).otherwise(text)))
    fresh = F.when(n == 1, section("S", F.lit(99), F.lit("new"), "other", F.lit("something else\nentirely\nhere")))
    every = sections_of(lines(spark, sf_dir), before, after, fresh)
    return every.withColumn("text_hash", F.sha2("text", 256))


@query(f"""
WITH p AS (SELECT 'b' || l_orderkey AS bill_key, l_linenumber AS n FROM {LINEITEM})
SELECT bill_key, count(*) FILTER (n = 2) AS changed, 3 + count(*) FILTER (n = 2) AS inserted, 2 * count(*) FILTER (n % 5 = 0) AS deleted, 1 + count(*) FILTER (n = 2 OR n % 5 = 0) AS sections_changed FROM p GROUP BY bill_key
""")
def diff_summary(spark, sf_dir):
    """Lines changed, put in and left out between two versions of every order, and sections that differ."""
    return diff.summary(diff.diff_versions(section_versions(spark, sf_dir), "I", "S"))


@query(f"""
SELECT 'b' || l_orderkey AS bill_key, 'I' AS version_code, 'sec-' || l_linenumber AS section_id FROM {LINEITEM}
UNION ALL SELECT 'b' || l_orderkey, 'AMD:S' || l_suppkey || '.1', 'sec-' || l_linenumber FROM {LINEITEM} WHERE l_returnflag = 'R' AND l_linenumber % 2 = 0
""")
def striking_versions(spark, sf_dir):
    """Striking amendments as versions beside those of the bill."""
    own = lines(spark, sf_dir).withColumns({"bill_key": F.concat(F.lit("b"), "l_orderkey"), "section_id": F.concat(F.lit("sec-"), "l_linenumber")})
    amended = own.where("l_returnflag = 'R'").select("bill_key", "section_id", F.concat(F.lit("S"), "l_suppkey", F.lit(".1")).alias("drafter_number"), (F.col("l_linenumber") % 2 == 0).alias("striking"))
    return diff.with_striking(own.select("bill_key", F.lit("I").alias("version_code"), "section_id"), amended).select("bill_key", "version_code", "section_id")


@query(f"""
WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS note, CAST(sum(CASE WHEN l_linenumber <= 2 THEN l_quantity END) AS DOUBLE) AS b, count(*) AS n FROM {LINEITEM} GROUP BY l_orderkey)
SELECT note, 1 AS place, NULL AS slot, (b - 10) * 2 AS value FROM v UNION ALL SELECT note, 2, 'b', b FROM v UNION ALL SELECT note, 3, 'c', b - 10 FROM v
UNION ALL SELECT note, 4, NULL, CAST(n AS DOUBLE) FROM v UNION ALL SELECT note, 5, NULL, NULL FROM v
""")
def recomputed(spark, sf_dir):
    """Computed cells of a note of every order: one reads a later one, one sums a wildcard, one reads nothing."""
    own = lines(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("note"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("q"))
    value = lambda path, v: F.struct(path.alias("path"), v.alias("value"))
    both = F.array(F.when(F.col("n") <= 2, value(F.concat(F.lit("q.fy"), "n"), F.col("q"))), value(F.concat(F.lit("one."), "n", F.lit(".fy1")), F.lit(1.0)))
    values = own.select("note", F.explode(both).alias("v")).where("v IS NOT NULL").select("note", "v.*")
    rules = [("c * 2", None), ("q.bien1", "b"), ("b - 10", "c"), ("sum(one.*.fy1)", None), ("nowhere", None)]
    every = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(e).alias("expr"), F.lit(s).cast("string").alias("slot")) for i, (e, s) in enumerate(rules, 1)])
    cells = own.select("note").distinct().select("note", F.explode(every).alias("c")).select("note", "c.*")
    return formula.recompute_notes(cells, values).select("note", "place", "slot", "value")


@query(f"""
WITH q AS (SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM {LINEITEM} GROUP BY l_orderkey)
SELECT CAST(k AS VARCHAR) AS doc_id, 'computed_mismatch' AS code, 'accounts/total/fy1' AS path, total AS expected, total + 5 AS actual FROM q WHERE k % 3 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'computed_mismatch', 'accounts/blank/fy1', total, NULL FROM q WHERE k % 4 = 0
""")
def computed_cells(spark, sf_dir):
    """Computed cells of every order's note that don't show what their expression yields, or nothing."""
    own = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("q")))).alias("x"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total"))
    k, none = F.col("l_orderkey"), F.lit(None).cast("string")
    cell = lambda slot, computed, value: F.struct(F.lit("noteCell").alias("type"), F.struct(F.lit("fy1").alias("col"), slot.alias("slot"), computed.alias("computed"), value.alias("value")).alias("attrs"))
    row = lambda key, c: F.struct(F.lit("noteRow").alias("type"), F.struct(key.alias("key")).alias("attrs"), F.array(c).alias("content"))
    rule = F.lit("sum(r.*.fy1)")
    accounts = F.transform("x", lambda r: row(r["n"].cast("string"), cell(F.concat(F.lit("r."), r["n"], F.lit(".fy1")), none, r["q"])))
    total = row(F.lit("total"), cell(none, rule, F.col("total") + F.when(k % 3 == 0, 5.0).otherwise(0.25)))
    blank = row(F.lit("blank"), cell(none, rule, F.when(k % 4 != 0, F.col("total"))))
    table = F.struct(F.lit("noteTable").alias("type"), F.struct(F.lit("accounts").alias("role")).alias("attrs"), F.concat(accounts, F.array(total, blank)).alias("content"))
    docs = own.select(k.cast("string").alias("id"), F.to_json(F.struct(F.lit("doc").alias("type"), F.array(table).alias("content"))).alias("doc"))
    return estimate.computed_errors(docs, "id", "doc")


def law_files(spark, sf_dir):
    """A law of every order as XML: a renumbered paragraph, a table with a row for each line, and a certificate."""
    t = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for i, p in enumerate(parts)])
    cell = F.transform(F.col("x"), lambda r: F.concat(F.lit("<TR><TD>"), r["n"].cast("string"), F.lit("</TD><TD"), F.when(r["n"] % 2 == 0, F.lit(' textAlign="right"')).otherwise(""), F.lit('><P><TextRun amendingStyle="strike">'), r["p"].cast("string"), F.lit('</TextRun></P><P><TextRun amendingStyle="add">'), r["q"].cast("string"), F.lit("</TextRun></P></TD></TR>")))
    own = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_suppkey").alias("p")))).alias("x"))
    own = own.withColumn("_rows", F.array_join(cell, "")).withColumn("_n", F.size("x"))
    law = t('<CertifiedBill xmlns="http://x/"><EnrollingCertificate><ChapterLaw year="2026">', "l_orderkey", '</ChapterLaw><PassedBy chamber="h"><PassedDate>March 6</PassedDate><Yeas>', "_n", "</Yeas></PassedBy></EnrollingCertificate>")
    body = t('<Bill><BillBody><BillSection type="new" action="amend"><P><TextRun amendingStyle="strike">(', "_n", ')</TextRun><TextRun amendingStyle="add">(', F.col("_n") + 1, ')</TextRun> Order ', "l_orderkey", '.</P><Table><THead><TR><TD colspan="2">Lines</TD></TR></THead>', "_rows", "</Table></BillSection></BillBody></Bill></CertifiedBill>")
    return own.select(F.col("l_orderkey").cast("string").alias("key"), F.lit("xml").alias("format"), F.concat(law, body).alias("content"))


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_linenumber AS INTEGER) AS line, 0 AS place, 1 AS column_span, false AS header, NULL AS align, CAST(l_linenumber AS VARCHAR) AS text, '' AS struck FROM {LINEITEM}
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS INTEGER), 1, 1, false, CASE WHEN l_linenumber % 2 = 0 THEN 'right' END, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '((' || l_suppkey || '))' FROM {LINEITEM}
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 0, 0, 2, true, NULL, 'Lines', '' FROM lineitem
""")
def parsed_tables(spark, sf_dir):
    """Cells of the tables of every order's law, in their grid."""
    return documents.parse_all(law_files(spark, sf_dir), "cells").select("key", F.col("row").alias("line"), F.col("column").alias("place"), "column_span", "header", "align", "text", "struck")


@query(f"""
WITH n AS (SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT key, '(' || (n + 1) || ')' AS label, 'ins' AS label_mark, '(' || n || ')' AS renumbered, 'Order ' || key || '.' AS text FROM n UNION ALL SELECT key, NULL, NULL, NULL, 'Lines' FROM n
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), NULL, NULL, NULL, l_linenumber || ' | ' || CAST(l_quantity AS INTEGER) FROM {LINEITEM}
""")
def parsed_blocks(spark, sf_dir):
    """Blocks of every order's law: a renumbered one, and one for each row of the table."""
    return documents.parse_all(law_files(spark, sf_dir), "blocks").select("key", "label", "label_mark", "renumbered", "text")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(l_orderkey AS INTEGER) AS chapter, 2026 AS year, 'H' AS chamber, 'March 6' AS date, CAST(count(*) AS INTEGER) AS yeas FROM lineitem GROUP BY l_orderkey")
def parsed_certificates(spark, sf_dir):
    return documents.parse_all(law_files(spark, sf_dir), "certificates").select("key", "chapter", "year", "chamber", "date", "yeas")


@query(f"""
WITH b AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE '(' || l_linenumber || ')' END AS own FROM {LINEITEM})
SELECT 'sec-1.' || l_linenumber AS block_id, CAST(l_orderkey AS VARCHAR) AS key, 'Section 1' || coalesce(own, '') || ' of HB ' || l_orderkey AS citation FROM b
UNION ALL SELECT 'sec-1.' || l_linenumber || '.a.i', CAST(l_orderkey AS VARCHAR), 'Section 1' || coalesce(own, '') || '(i) of HB ' || l_orderkey FROM b
""")
def block_paths(spark, sf_dir):
    """Citations of blocks and of blocks below them; some have no label, and one level isn't there."""
    n, key = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")
    own = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("("), n, F.lit(")")))
    both = F.array(F.struct(F.concat(F.lit("sec-1."), n).alias("block_id"), own.alias("label")), F.struct(F.concat(F.lit("sec-1."), n, F.lit(".a.i")).alias("block_id"), F.lit("(i)").alias("label")))
    blocks = lines(spark, sf_dir).select(key.alias("key"), F.lit("sec-1").alias("section_id"), F.lit(1).alias("num"), F.explode(both).alias("b")).select("key", "section_id", "num", "b.*")
    return bill_ops.block_citations(blocks, F.concat(F.lit("HB "), "key")).select("key", "block_id", "citation")


@query(f"""
WITH n AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 4 = 1) AS c, count(*) FILTER (l_linenumber % 4 = 2) AS i, count(*) FILTER (l_linenumber > 7) AS d FROM {LINEITEM} GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(nullif(concat_ws(', ', CASE WHEN c > 0 THEN c || CASE WHEN c = 1 THEN ' line changed' ELSE ' lines changed' END END, CASE WHEN i > 0 THEN i || CASE WHEN i = 1 THEN ' line added' ELSE ' lines added' END END,
  CASE WHEN d > 0 THEN d || CASE WHEN d = 1 THEN ' line removed' ELSE ' lines removed' END END), ''), 'No changes') AS said FROM n
""")
def diff_sentences(spark, sf_dir):
    n = F.col("l_linenumber")
    counts = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count_if(n % 4 == 1).alias("c"), F.count_if(n % 4 == 2).alias("i"), F.count_if(n > 7).alias("d"))
    return counts.select("l_orderkey", diff.sentence(F.col("c"), F.col("i"), F.col("d")).alias("said"))


@query("""
WITH y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) AS INTEGER) ELSE 2026 END AS first FROM orders)
SELECT o_orderkey, first AS first_year, first + 9 AS last_year, (first - 1) || '-' || lpad(CAST((first + 1) % 100 AS VARCHAR), 2, '0') || ',' || (first + 1) || '-' || lpad(CAST((first + 3) % 100 AS VARCHAR), 2, '0') || ',' || (first + 3) || '-' || lpad(CAST((first + 5) % 100 AS VARCHAR), 2, '0') AS biennia FROM y
""")
def header_years(spark, sf_dir):
    """Fiscal years of every order's tables: named by the second table, by one cell too few, or by none."""
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 3
    cells = F.when(k == 0, F.array(F.concat(F.lit("FY "), y), F.concat(F.lit("FY"), (F.year("o_orderdate") + 1).cast("string")))).when(k == 1, F.array(F.lit("Fund"), F.concat(F.lit("FY "), y))).otherwise(F.array(F.lit(None).cast("string")))
    years = estimate.fiscal_years(F.array(F.array(F.lit("Account")), cells), F.lit(2025))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", years.alias("y"))
    return rows.select("o_orderkey", F.get("y", F.lit(0)).alias("first_year"), F.element_at("y", -1).alias("last_year"), F.array_join(estimate.biennia_of(F.col("y")), ",").alias("biennia"))
