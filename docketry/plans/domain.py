"""Queries of the operators that need Python: folds, diffs, formulas and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from docketry.functions.html import html_text as text_of_html
from docketry.operators import diff, formula, workflow
from docketry.plans.catalogue import query, read
from docketry.streaming import relay


def scratch(spark) -> str:
    """A new folder below the one that driver and executors share; a local master may do without and gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='docketry-')}"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


COMMAND = {"view": "SUBMIT", "click": "REQUEST_CHANGES", "purchase": "APPROVE", "error": "PUBLISH", "signup": "ARCHIVE"}


def commands(spark, sf_dir):
    """Events as workflow commands: an instance for each user, actors and messages by the event's id."""
    e = read(spark, sf_dir, "events")
    who = F.col("event_id") % 3
    return e.select(
        F.col("user_id").cast("string").alias("instance_id"),
        F.col("event_id").alias("arrival"),
        F.create_map(*[F.lit(x) for kv in COMMAND.items() for x in kv])[F.col("event_type")].alias("event"),
        F.when(who == 0, "d").when(who == 1, "r").otherwise("v").alias("actor_id"),
        F.when(who == 0, F.array(F.lit("drafter"))).when(who == 1, F.array(F.lit("reviewer"))).otherwise(F.array(F.lit("viewer"))).alias("actor_roles"),
        F.lit("d").alias("drafter_id"),
        F.when(F.col("event_id") % 2 == 0, "m").otherwise(" ").alias("message"),
        F.lit(None).cast("int").alias("expected_version"),
        (F.col("event_id") % 5).cast("int").alias("head_version"),
    )


_STEP = """CASE WHEN c.event = 'ARCHIVE' THEN 'unknown_event'
 WHEN NOT ((s.state IN ('draft', 'changes_requested') AND c.event = 'SUBMIT') OR (s.state = 'in_review' AND c.event IN ('REQUEST_CHANGES', 'APPROVE')) OR (s.state = 'approved' AND c.event = 'PUBLISH')) THEN 'not_in_state'
 WHEN (c.event = 'SUBMIT' AND c.who <> 0) OR (c.event <> 'SUBMIT' AND c.who <> 1) THEN 'not_allowed'
 WHEN c.event = 'REQUEST_CHANGES' AND c.arrival % 2 = 1 THEN 'message_required' END"""
_NEXT = "CASE c.event WHEN 'SUBMIT' THEN 'in_review' WHEN 'REQUEST_CHANGES' THEN 'changes_requested' WHEN 'APPROVE' THEN 'approved' ELSE 'published' END"


@query(f"""
WITH RECURSIVE c AS (
  SELECT CAST(user_id AS VARCHAR) AS instance_id, event_id AS arrival, event_id % 3 AS who, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         CASE event_type WHEN 'view' THEN 'SUBMIT' WHEN 'click' THEN 'REQUEST_CHANGES' WHEN 'purchase' THEN 'APPROVE' WHEN 'error' THEN 'PUBLISH' ELSE 'ARCHIVE' END AS event FROM events),
s AS (
  SELECT DISTINCT instance_id, CAST(NULL AS BIGINT) AS arrival, CAST(0 AS BIGINT) AS n, 'draft' AS state, CAST(NULL AS VARCHAR) AS from_state, CAST(NULL AS VARCHAR) AS reason, 0 AS version FROM c
  UNION ALL
  SELECT c.instance_id, c.arrival, c.n, CASE WHEN r IS NULL THEN nx ELSE s.state END, s.state, r, s.version + CASE WHEN r IS NULL THEN 1 ELSE 0 END
  FROM s JOIN (SELECT * FROM c) c ON c.instance_id = s.instance_id AND c.n = s.n + 1, LATERAL (SELECT {_STEP} AS r, {_NEXT} AS nx))
SELECT instance_id, arrival, from_state, CASE WHEN reason IS NULL THEN state END AS to_state, reason, CAST(version AS INTEGER) AS version FROM s WHERE n > 0
""")
def workflow_fold(spark, sf_dir):
    return workflow.fold_workflow(commands(spark, sf_dir)).select("instance_id", "arrival", "from_state", "to_state", "reason", "version")


@query("""
SELECT event_id AS arrival, CASE WHEN event_type = 'signup' THEN 'unknown_event' WHEN event_type NOT IN ('click', 'purchase') THEN 'not_in_state'
  WHEN event_id % 3 <> 1 THEN 'not_allowed' WHEN event_type = 'click' AND event_id % 2 = 1 THEN 'message_required' END AS reason FROM events
""")
def workflow_judge(spark, sf_dir):
    return workflow.judge(commands(spark, sf_dir).withColumn("state", F.lit("in_review"))).select("arrival", "reason")


@query("""
SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) FILTER (l_linenumber = 1) AS DOUBLE) AS fy1, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) FILTER (l_linenumber = 2) AS DOUBLE) AS fy2,
  CASE WHEN fy1 IS NOT NULL OR fy2 IS NOT NULL THEN coalesce(fy1, 0) + coalesce(fy2, 0) END AS bien,
  CASE WHEN bien IS NOT NULL THEN coalesce(bien, 0) - 10 ELSE -10 END AS less, fy1 * 2 / nullif(fy2, 0) AS ratio
FROM lineitem GROUP BY l_orderkey
""")
def formula_eval(spark, sf_dir):
    line = lambda n: F.sum(F.when(F.col("l_linenumber") == n, F.col("l_quantity").cast("decimal(18,2)"))).cast("double")
    sums = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(line(1).alias("fy1"), line(2).alias("fy2"))
    values = F.map_filter(F.create_map(F.lit("q.fy1"), "fy1", F.lit("q.fy2"), "fy2"), lambda k, v: v.isNotNull())
    cells = {"bien": "q.bien1", "less": "q.bien1 - 10", "ratio": "q.fy1 * 2 / q.fy2"}
    return sums.select("l_orderkey", "fy1", "fy2", *[formula.compile_column(e, values).alias(c) for c, e in cells.items()])


@query()
def line_diff(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before")), ["conv_id", "turn"])
    return diff.line_diff_columns(pairs, "before", "text").select("conv_id", "turn", "n_equal", "n_changed", "n_inserted", "n_deleted")


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '[\s\p{Z}\x{FEFF}]+', ' ', 'g'), '^ | $', '', 'g') AS content FROM pages
""")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text_of_html(F.col("html")).alias("content"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')")
def event_relay(spark, sf_dir):
    at = scratch(spark)
    schema = read(spark, sf_dir, "events").schema
    for _ in range(2):  # the second run finds every event claimed
        relay.relay(spark, sf_dir, schema, "index", f"{at}/claims", f"{at}/checkpoint-{uuid.uuid4().hex}", lambda batch: batch.select("event_id", "event_type").write.mode("append").parquet(f"{at}/out"), ["purchase", "error"], "events.parquet").awaitTermination()
    return spark.read.parquet(f"{at}/out")
