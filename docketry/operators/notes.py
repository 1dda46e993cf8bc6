"""Notes: optimistic saves, versions for export, the published feed and its cursors."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators import relational as op

# Least, usual and most rows of a page by what is listed, and states in the order of their path.
LIMITS = {"published": (1, 50, 200), "search": (1, 20, 100), "hearings": (1, 2000, 2000), "transitions": (1, 500, 500)}
PATH = ("draft", "in_review", "changes_requested", "approved", "published")


def clamped(limit: int | None, listed: str) -> int:
    """A page's number of rows within what is allowed."""
    least, usual, most = LIMITS[listed]
    return usual if limit is None else max(least, min(most, limit))


def save_all(saves: Iterable[dict], head: int = 0) -> tuple[list[dict], int]:
    """(a result for each save in order, the head after them). A save without an expected version is 400, with a stale
    one 412 and the head; an accepted one adds a version."""
    out = []
    for s in saves:
        if s.get("if_match") is None:
            out.append({"status": 400, "version": None, "head": head})
        elif s["if_match"] != head:
            out.append({"status": 412, "version": None, "head": head})
        else:
            head += 1
            out.append({"status": 200, "version": head, "head": head})
    return out, head


def export_version(roles: Column, state: Column, approved: Column, published: Column, asked: Column, head: Column) -> Column:
    """Struct (status, version) of an export.

    Drafters, reviewers and admins get the version that they ask for, else the published one of a published note, the
    approved one of an approved note, else the head. Others get the published version of a published note alone.
    """
    part = F.coalesce(F.arrays_overlap(roles, F.array(*map(F.lit, ("drafter", "reviewer", "admin")))), F.lit(False))
    public = F.coalesce(state == "published", F.lit(False))
    frozen = F.when(public, published).when(state == "approved", approved)
    wanted = F.coalesce(asked, F.when(part, F.coalesce(frozen, head)).otherwise(published))
    status = F.when((~part & ~public) | wanted.isNull(), 404).when(~part & ~wanted.eqNullSafe(published), 403).otherwise(200)
    return F.struct(status.alias("status"), F.when(status == 200, wanted).alias("version"))


def encode_cursor(at: str, key: str) -> str:
    return base64.urlsafe_b64encode(f"{at}|{key}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    """(time, id) of a cursor; anything else raises ValueError."""
    text = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode("utf-8", "replace")
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?Z?)\|([\w-]+)", text)
    if not m:
        raise ValueError("not a cursor of this feed")
    return m[1], m[2]


def published_feed(revisions: DataFrame, notes: DataFrame, bills: DataFrame, versions: DataFrame, users: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """A page of published notes with bill, version and publisher, newest first, and one row more if a page follows."""
    some = revisions.where("published_at IS NOT NULL").withColumn("at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss.SSS"))
    page = op.keyset_page(some, "at", "note_revision_id", clamped(limit, "published"), decode_cursor(cursor) if cursor else None)
    people = users.select(F.col("user_id").alias("published_by"), F.col("name").alias("publisher"))
    return page.join(notes, "note_id").join(bills.select("bill_key", "title"), "bill_key", "left").join(versions.select("bill_key", "version_code", "label"), ["bill_key", "version_code"], "left").join(people, "published_by", "left").withColumn("publisher", F.coalesce("publisher", F.lit("System")))


def with_people(rows: DataFrame, user_id: str, users: DataFrame, name: str) -> DataFrame:
    """All columns plus the name of the user that each row refers to; `System` where there is none."""
    people = users.select(F.col("user_id").alias("_user"), F.col("name").alias(name))
    return rows.join(people, F.col(user_id) == F.col("_user"), "left").drop("_user").withColumn(name, F.coalesce(name, F.lit("System")))


def threads(comments: DataFrame, messages: DataFrame) -> DataFrame:
    """Comments (note_id, comment_id, pos, status) with their messages (comment_id, at, message_id, body) as an ordered array.

    `place` numbers a note's comments by where they stand, detached ones last. Comments without messages have none.
    """
    made = messages.groupBy("comment_id").agg(F.array_sort(F.collect_list(F.struct("at", "message_id", "body"))).alias("messages"))
    out = comments.join(made, "comment_id", "left").withColumn("messages", F.coalesce("messages", F.array().cast(made.schema["messages"].dataType)))
    return op.running_occurrence(out, ["note_id"], [F.col("pos").asc_nulls_last(), F.col("comment_id")], "place")


def open_threads(comments: DataFrame) -> DataFrame:
    """(note_id, open): comments of each note that aren't resolved."""
    return comments.groupBy("note_id").agg(F.count_if(F.col("status") == "open").alias("open"))


def counts_by_section(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("bill_key", "version_code", "section_id").agg(F.count(F.lit(1)).alias("n"))


def error_counts(versions: DataFrame, errors: str = "errors") -> DataFrame:
    """All columns but the errors, with their number; none for null."""
    return versions.withColumn("n_errors", F.greatest(F.size(F.coalesce(F.col(errors), F.array().cast(versions.schema[errors].dataType))), F.lit(0))).drop(errors)


def by_status(notes: DataFrame, state: str = "state") -> DataFrame:
    """(state, place, n) of the states that notes are in, in the order of their path; empty ones drop out."""
    place = F.array_position(F.array(*map(F.lit, PATH)), F.col(state)).cast("int")
    return notes.groupBy(F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.nullif(place, F.lit(0)))


def history_page(transitions: DataFrame, instance: str, before: int | None = None, limit: int | None = None) -> DataFrame:
    """A page of an instance's transitions before a sequence number, the latest first."""
    own = transitions.where(op.all_of([F.col("instance_id") == instance, None if before is None else F.col("seq") < before]))
    return own.orderBy(F.col("seq").desc()).limit(clamped(limit, "transitions"))


def seeded_users(users: DataFrame, seeds: DataFrame) -> DataFrame:
    """Users after seeding: seeds replace or join them; those of development that the seeds lack are gone."""
    kept = op.delete_where(users, F.col("user_id").startswith("dev-"), seeds, "user_id")
    return op.upsert(kept, seeds, ["user_id"])


def ingest_counters(events: DataFrame, kind: str = "type") -> DataFrame:
    """One row of counters of a reload's events, by what happened."""
    count = lambda *kinds: F.count_if(F.col(kind).isin(*kinds))
    return events.agg(
        count("bill.created").alias("created"), count("bill.status_changed").alias("changed"), count("bill.version_added").alias("versions"), count("bill.amendment_added").alias("amendments"), count("hearing.scheduled", "hearing.rescheduled", "hearing.cancelled").alias("hearings"), F.count(F.lit(1)).alias("events"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    """Appends to a log that is never rewritten, as of audits and of runs; each row gets the time of writing."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def cite_key(*parts: Column) -> Column:
    """A composite key in which null is the same as empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
