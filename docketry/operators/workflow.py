"""The review workflow: a table of rules, a fold of commands into states, and a permission matrix.

A fold needs the commands of one instance in order and nothing else; its state is a small tuple, and the same function
serves the stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values: (from, event, who, to, whether a message is needed), and states.
RULES = (
    ("draft", "SUBMIT", "drafter", "in_review", False),
    ("changes_requested", "SUBMIT", "drafter", "in_review", False),
    ("in_review", "REQUEST_CHANGES", "reviewer", "changes_requested", True),
    ("in_review", "APPROVE", "reviewer", "approved", False),
    ("approved", "PUBLISH", "reviewer", "published", False),
)
STATES = ("draft", "in_review", "changes_requested", "approved", "published")
EVENTS = tuple(dict.fromkeys(r[1] for r in RULES))
EDITABLE = ("draft", "changes_requested")


def acts_as(who: str, actor: str, roles: Sequence[str], drafter: str | None) -> bool:
    """The drafter is the one of the note; a reviewer holds the role and isn't that drafter."""
    if who == "drafter":
        return drafter is not None and actor == drafter
    return "reviewer" in roles and actor != drafter


def decide(state: str, event: str, actor: str, roles: Sequence[str], drafter: str | None, message: str | None) -> tuple[str | None, str | None]:
    """(next state, None) or (None, reason), the reasons in order: unknown_event, not_in_state, not_allowed, message_required."""
    if event not in EVENTS:
        return None, "unknown_event"
    rule = next((r for r in RULES if r[:2] == (state, event)), None)
    if rule is None:
        return None, "not_in_state"
    if not acts_as(rule[2], actor, roles, drafter):
        return None, "not_allowed"
    if rule[4] and not (message or "").strip():
        return None, "message_required"
    return rule[3], None


def available(state: str, actor: str, roles: Sequence[str], drafter: str | None) -> list[str]:
    return [r[1] for r in RULES if r[0] == state and acts_as(r[2], actor, roles, drafter)]


START = {"state": "draft", "version": 0, "reviewer_id": None, "approved_version": None, "published_version": None, "open_request": None}
STEP = "instance_id string, arrival long, event string, from_state string, to_state string, version int, reason string, reviewer_id string, approved_version int, published_version int, open_request string, resolution string"


def fold(commands: Iterable[dict], start: dict | None = None) -> tuple[list[dict], dict]:
    """(a step for each command in order, the state after them). A stale expected version is refused before the rules.

    Folding a log equals folding its first part and then the rest from there.
    """
    now, steps = {**START, **(start or {})}, []
    for c in commands:
        before, message, resolution = now["state"], (c.get("message") or "").strip() or None, None
        if c.get("expected_version") is not None and c["expected_version"] != now["version"]:
            to, reason = None, "version_mismatch"
        else:
            to, reason = decide(before, c["event"], c["actor_id"], c["actor_roles"], c.get("drafter_id"), message)
        if to:
            now = {**now, "state": to, "version": now["version"] + 1}
            if c["event"] != "SUBMIT" and now["reviewer_id"] is None:
                now["reviewer_id"] = c["actor_id"]
            if c["event"] == "REQUEST_CHANGES":
                now["open_request"] = message
            elif c["event"] == "SUBMIT" and before == "changes_requested":
                now["open_request"], resolution = None, message
            elif c["event"] == "APPROVE":
                now["approved_version"] = c.get("head_version")
            elif c["event"] == "PUBLISH":
                now["published_version"] = now["approved_version"] if now["approved_version"] is not None else c.get("head_version")
        steps.append({"event": c["event"], "arrival": c["arrival"], "from_state": before, "to_state": to, "reason": reason, "resolution": resolution, **{k: now[k] for k in START if k != "state"}})
    return steps, now


COMMAND = ["instance_id", "arrival", "event", "actor_id", "actor_roles", "drafter_id", "message", "expected_version", "head_version"]


def fold_workflow(commands: DataFrame) -> DataFrame:
    """Steps of every instance, from (instance_id, arrival, event, actor_id, actor_roles, drafter_id, message,
    expected_version, head_version).

    Instances are dealt out by id and their commands laid in order; a task then folds them as they stream by, keeping
    the state of one instance at a time, so that a log of any length takes no more memory. Commands without an
    instance are one instance.
    """
    shape = to_arrow_schema(StructType.fromDDL(STEP))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for instance, rows in groupby(batch.to_pylist(), key=lambda r: r["instance_id"]):
                made, state = fold(rows, state if state is not None and instance == last else None)
                last = instance
                out += [{"instance_id": instance, **m} for m in made]
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    dealt = commands.select(*COMMAND).repartition("instance_id").sortWithinPartitions("instance_id", "arrival")
    return dealt.mapInArrow(steps, STEP)


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*RULES], "from_state string, event string, who string, to_state string, needs_message boolean")


def judge(requests: DataFrame, state: str = "state", event: str = "event") -> DataFrame:
    """Each request with `to_state` or `reason`, in built-in expressions; the rules are joined as a broadcast table."""
    rules = F.broadcast(rules_table(requests.sparkSession)).withColumnsRenamed({"from_state": "_from", "event": "_event", "to_state": "_to"})
    joined = requests.join(rules, (F.col(state) == F.col("_from")) & (F.col(event) == F.col("_event")), "left")
    drafter = F.coalesce(F.col("actor_id") == F.col("drafter_id"), F.lit(False))
    acts = F.when(F.col("who") == "drafter", drafter).otherwise(F.array_contains("actor_roles", "reviewer") & ~drafter)
    reason = F.when(~F.col(event).isin(*EVENTS), "unknown_event").when(F.col("_to").isNull(), "not_in_state").when(~acts, "not_allowed").when(F.col("needs_message") & (F.trim(F.coalesce("message", F.lit(""))) == ""), "message_required")
    return joined.withColumn("reason", reason).withColumn("to_state", F.when(F.col("reason").isNull(), F.col("_to"))).drop("_from", "_event", "_to", "who", "needs_message")


ACTIONS = ("bill.read", "template.read", "search.reindex", "note.create", "note.read", "note.export", "note.comment", "note.edit", "note.submit", "note.review", "note.publish")


def can(action: str, roles: Column, user: Column, state: Column | None = None, drafter: Column | None = None, reviewer: Column | None = None, participants: Column | None = None) -> Column:
    """Whether a user with these roles may do an action, as a boolean column that is never null.

    Without a note (state is None) only an admin may do what is done to notes; `drafter` is then whom a new note is
    meant for. Everyone reads bills, templates and published notes.
    """
    has = lambda *names: F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, names))), F.lit(False))
    null = F.lit(None).cast("string")
    drafts = F.coalesce((null if drafter is None else drafter) == user, F.lit(False))
    if action in ("bill.read", "template.read"):
        return F.lit(True)
    if action == "note.create":
        free = F.coalesce(null if drafter is None else drafter, F.lit("")) == ""
        return has("admin", "reviewer") | (has("drafter") & (free | drafts))
    if action == "search.reindex" or state is None:
        return has("admin")
    own = drafts | F.coalesce((null if reviewer is None else reviewer) == user, F.lit(False))
    if participants is not None:
        own = own | F.coalesce(F.array_contains(participants, user), F.lit(False))
    reads = has("admin", "reviewer") | F.coalesce(state == "published", F.lit(False)) | (has("drafter") & own)
    in_state = lambda *states: F.coalesce(state.isin(*states), F.lit(False))
    by_action = {
        "note.read": reads,
        "note.export": reads,
        "note.comment": reads & has("drafter", "reviewer", "admin"),
        "note.edit": in_state(*EDITABLE) & drafts,
        "note.submit": in_state(*EDITABLE) & drafts,
        "note.review": in_state("in_review") & has("reviewer") & ~drafts,
        "note.publish": in_state("approved") & has("reviewer") & ~drafts,
    }
    return by_action.get(action, F.lit(False))


def change_requests(steps: DataFrame) -> DataFrame:
    """Each accepted request for changes with the submission that resolves it, if any."""
    from pyspark.sql import Window

    some = steps.where("to_state IS NOT NULL AND event IN ('SUBMIT', 'REQUEST_CHANGES')")
    after = Window.partitionBy("instance_id").orderBy("version")
    some = some.withColumn("resolved_at", F.lead("arrival").over(after)).withColumn("resolution", F.lead("resolution").over(after))
    return some.where("event = 'REQUEST_CHANGES'").select("instance_id", "version", F.col("open_request").alias("summary"), "resolved_at", "resolution")
