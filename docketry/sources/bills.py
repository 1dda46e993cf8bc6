"""Bill records: nested JSON into bills, versions, amendments, hearings and prior notes, and the events of a reload.

Everything is built-in expressions over one read of the files; schemas are declared, never inferred. A reload compares
each bill's hash with the stored one and works on changed bills only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import refs
from docketry.functions.text import biennium_column, once, pacific_to_utc
from docketry.operators import relational as op

BILL = """bill_id long, change_hash string, status int, status_date string, session struct<year_start:int,year_end:int,session_name:string>,
 bill_number string, bill_type string, body string, current_body string, title string, description string, committee struct<committee_id:long,chamber:string,name:string>,
 progress array<struct<date:string,event:int>>, referrals array<struct<date:string,committee_id:long,name:string>>, history array<struct<date:string,action:string,chamber:string,importance:int>>,
 sponsors array<struct<people_id:long,party:string,name:string,last_name:string,district:string,sponsor_type_id:int,sponsor_order:int>>, sasts array<struct<type:string,sast_bill_number:string,sast_bill_id:long>>,
 texts array<struct<doc_id:long,date:string,type:string,state_link:string,text_hash:string>>, amendments array<struct<amendment_id:long,adopted:int,chamber:string,date:string,title:string,description:string,state_link:string,amendment_hash:string>>,
 supplements array<struct<supplement_id:long,date:string,type:string,title:string,description:string,state_link:string,supplement_hash:string>>, calendar array<struct<type_id:int,event_hash:string,type:string,date:string,time:string,location:string,description:string>>"""

# Status codes and the search status of each.
STATUS = {1: "introduced", 2: "engrossed", 3: "enrolled", 4: "passed", 5: "vetoed", 6: "failed"}
SEARCH_STATUS = {"introduced": "in_committee", "engrossed": "passed_origin", "enrolled": "passed_legislature", "passed": "passed", "vetoed": "vetoed", "failed": "failed"}


def named(code: Column, names: dict, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code), F.lit(default))


def real_date(text: Column) -> Column:
    """A date; the source writes 0000-00-00 for none."""
    return F.when(text != "0000-00-00", text.try_cast("date"))


def read_dataset(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """One row for each file, an object under `bill`; malformed files are left out. `names` picks files by bill number."""
    rows = spark.read.schema(f"bill struct<{_typed(BILL)}>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    bills = rows.where("bill IS NOT NULL").select("bill.*")
    return bills.where(F.col("bill_number").isin(names)) if names else bills


def _typed(ddl: str) -> str:
    """A column list as the fields of a struct."""
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl.replace("\n", " ")).fields)


def keyed(bills: DataFrame) -> DataFrame:
    biennium = biennium_column(F.col("session.year_start"))
    return bills.withColumn("biennium", biennium).withColumn("bill_key", F.concat(F.lit("WA:"), biennium, F.lit(":"), F.col("bill_number")))


def bills_table(bills: DataFrame) -> DataFrame:
    last = F.array_max(F.transform(F.filter("history", lambda h: real_date(h["date"]).isNotNull()), lambda h: F.struct(h["date"].alias("date"), h["action"].alias("action"))))
    status = named(F.col("status"), STATUS, "unknown")
    companion = F.get(F.filter("sasts", lambda s: F.lower(s["type"]).isin("crossfiled", "same as")), F.lit(0))["sast_bill_number"]
    sponsors = F.transform(F.array_sort(F.transform("sponsors", lambda s: F.struct(s["sponsor_order"].alias("ord"), s["people_id"].alias("people_id"), s["name"].alias("name"), s["last_name"].alias("last_name")))), lambda s: F.struct(s["people_id"], s["name"], s["last_name"]))
    passed = F.get(F.reverse(F.filter("history", lambda h: h["action"].rlike(r"Chapter \d+, \d{4} Laws"))), F.lit(0))["action"]
    chapter = F.regexp_extract(F.coalesce(passed, F.lit("")), r"(Chapter \d+, \d{4} Laws)", 1)
    return keyed(bills).select(
        "bill_key", "biennium", "bill_number", F.regexp_extract("bill_number", "^([A-Z]+)", 1).alias("type"), F.regexp_extract("bill_number", r"(\d+)$", 1).try_cast("int").alias("number"), F.substring("bill_number", 1, 1).alias("chamber"),
        "title", "description", "change_hash", status.alias("status"), named(status, SEARCH_STATUS, "prefiled").alias("search_status"), real_date(F.col("status_date")).alias("status_date"), F.col("committee.name").alias("committee"),
        sponsors.alias("sponsors"), last["date"].try_cast("date").alias("last_action_date"), last["action"].alias("last_action"), companion.alias("companion"), F.nullif(chapter, F.lit("")).alias("chapter_law"),
    )


def version_code(link: Column) -> Column:
    """Version code from the name of a version file, I as introduced."""
    known = F.regexp_extract(F.substring_index(link, "/", -1), r"^\d{4}(?:-S\d?)?(?:\.(?:E\d?|PL|SL))?", 0)
    return F.when(F.length(known) > 4, F.substring(known, 6, 99)).when(F.length(known) == 4, "I")


def versions_table(bills: DataFrame) -> DataFrame:
    """Versions by code, the first text of each, with sequence and sources still to be fetched."""
    rows = keyed(bills).select("bill_key", F.posexplode("texts").alias("pos", "t"))
    rows = rows.select("bill_key", "pos", version_code(F.col("t.state_link")).alias("version_code"), F.col("t.doc_id").alias("doc_id"), real_date(F.col("t.date")).alias("date"), F.col("t.text_hash").alias("text_hash"), F.col("t.state_link").alias("link"))
    first = op.collapse(rows, ["bill_key", "version_code"], [F.col("pos")]).where("version_code IS NOT NULL")
    return first.withColumn("seq", refs.version_seq_column(F.col("version_code"))).withColumn("status", F.lit("pending")).drop("pos")


def amendments_table(bills: DataFrame) -> DataFrame:
    rows = keyed(bills).select("bill_key", F.explode("amendments").alias("a"))
    name = F.element_at(F.split("a.state_link", "/"), -1)
    return rows.select("bill_key", F.col("a.amendment_id").alias("amendment_id"), F.col("a.title").alias("title"), F.regexp_extract(name, r"([HS]-?\d{4}\.\w+?)(?:\.\w{3})?$", 1).alias("drafter_number"), F.regexp_extract(name, r"AM([HSC])", 1).alias("chamber"), ((F.col("a.adopted") == 1) | F.upper(F.coalesce("a.description", F.lit(""))).startswith("ADOPTED")).alias("adopted"), real_date(F.col("a.date")).alias("date"), F.col("a.amendment_hash").alias("amendment_hash"))


def hearings_table(bills: DataFrame) -> DataFrame:
    """Hearings with UTC times; a time that can't be read counts as midnight."""
    rows = keyed(bills).select("bill_key", F.explode("calendar").alias("c"))
    time = F.when(F.col("c.time").rlike(r"^\d{1,2}:\d{2}"), F.col("c.time")).otherwise("00:00")
    local = F.try_to_timestamp(F.concat_ws(" ", "c.date", time), F.lit("yyyy-MM-dd H:mm"))
    what = F.lower(F.coalesce("c.description", F.lit("")))
    kind = F.when(what.contains("public hearing"), "public_hearing").when(what.contains("executive session") | what.contains("executive action"), "executive_session").otherwise("other")
    return rows.select(F.concat_ws(":", "bill_key", "c.event_hash").alias("id"), "bill_key", kind.alias("kind"), pacific_to_utc(local).alias("at"), F.col("c.location").alias("location"), F.lit(False).alias("cancelled"))


def prior_notes_table(bills: DataFrame) -> DataFrame:
    rows = keyed(bills).select("bill_key", F.explode("supplements").alias("s")).where(F.lower("s.type").contains("fiscal"))
    return rows.select(F.concat_ws(":", "bill_key", "s.supplement_id").alias("id"), "bill_key", F.col("s.description").alias("description"), real_date(F.col("s.date")).alias("date"), F.col("s.state_link").alias("link"))


def changed(bills: DataFrame, stored: DataFrame) -> DataFrame:
    """Bills that are new or whose hash differs from the stored one."""
    old = stored.select("bill_key", F.col("change_hash").alias("_old"))
    return keyed(bills).join(old, "bill_key", "left").where(~F.col("change_hash").eqNullSafe(F.col("_old"))).drop("_old", "bill_key", "biennium")


def events(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(type, bill_key, subject) of a reload: what is new, what moved and what was called off. Rows that a reload left
    as they were have no events, so `new` may be without them."""
    b = new["bills"].join(old["bills"].select("bill_key", F.col("status").alias("_was")), "bill_key", "left")
    h = new["hearings"].join(old["hearings"].select("id", F.col("at").alias("_at"), F.col("cancelled").alias("_c")), "id", "left")

    def of(kind: str, rows: DataFrame, subject: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("type"), "bill_key", F.col(subject).cast("string").alias("subject"))

    parts = [
        of("bill.created", b.where("_was IS NULL"), "bill_key"),
        of("bill.status_changed", b.where("_was IS NOT NULL AND _was <> status"), "status"),
        of("bill.version_added", new["versions"].join(old["versions"], ["bill_key", "version_code"], "left_anti"), "version_code"),
        of("bill.amendment_added", new["amendments"].join(old["amendments"], "amendment_id", "left_anti"), "amendment_id"),
        of("hearing.scheduled", h.where("_at IS NULL AND NOT cancelled"), "id"),
        of("hearing.rescheduled", h.where("_at <> at"), "id"),
        of("hearing.cancelled", h.where("cancelled AND NOT _c"), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tables(bills: DataFrame) -> dict[str, DataFrame]:
    return {"bills": bills_table(bills), "versions": versions_table(bills), "amendments": amendments_table(bills), "hearings": hearings_table(bills), "prior_fiscal_notes": prior_notes_table(bills)}


KEYS = {"bills": ["bill_key"], "versions": ["bill_key", "version_code"], "amendments": ["amendment_id"], "hearings": ["id"], "prior_fiscal_notes": ["id"]}


def reload(bills: DataFrame, stored: dict[str, DataFrame], as_of: Column, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after a reload, its events). Only changed bills are upserted; hearings of theirs that lie ahead and
    weren't seen again are cancelled. `hold` writes a table that several results read and reads it again.

    Only the keys of changed bills are held: their tables are made anew where they are read, of the columns read there,
    and events are told from the changed rows alone.
    """
    keys = hold(keyed(changed(bills, stored["bills"])).select(F.col("bill_key").alias("_key")).distinct())
    of_changed = lambda df: df.join(keys, F.col("bill_key").eqNullSafe(F.col("_key")), "left_semi")
    fresh = {name: of_changed(df) for name, df in tables(bills).items()}
    after = {name: op.upsert(stored[name], fresh[name], KEYS[name]) for name in fresh}
    gone = op.soft_delete(of_changed(stored["hearings"]), fresh["hearings"], "id", "at", as_of).where("cancelled")
    after["hearings"] = op.upsert(after["hearings"], gone, ["id"])
    once = {name: df.dropDuplicates(KEYS[name]) for name, df in fresh.items()}
    return after, events(stored, once | {"hearings": op.upsert(fresh["hearings"], gone, ["id"])})


def fetched(versions: DataFrame, xml: DataFrame, htm: DataFrame) -> DataFrame:
    """Versions with their source: XML before HTM, else missing. Files are (file_name, content)."""
    base = F.regexp_replace(F.element_at(F.split("link", "/"), -1), r"\.\w+$", "")
    v = versions.withColumn("_base", base)
    side = lambda df, ext: df.select(F.regexp_replace("file_name", rf"\.{ext}$", "").alias("_base"), F.col("content").alias(f"_{ext}"))
    v = v.join(side(xml, "xml"), "_base", "left").join(side(htm, "htm"), "_base", "left")
    return v.withColumn("content", F.coalesce("_xml", "_htm")).withColumn("format", F.when(F.col("_xml").isNotNull(), "xml").when(F.col("_htm").isNotNull(), "htm")).withColumn("status", F.when(F.col("content").isNull(), "missing").otherwise("parsed")).drop("_base", "_xml", "_htm")


def committee_of(location: Column) -> Column:
    """Struct (chamber, committee) of where a hearing is held: "House Committee on ..." names both, Joint ones have no chamber; else the place as it is."""
    words = lambda place: F.split(F.regexp_replace(place, r"\s+", " "), " ", 4)
    return once(F.trim(location), lambda place: once(F.struct(place.alias("place"), words(place).alias("said")), lambda v: _committee(v["place"], v["said"])))


def _committee(place: Column, said: Column) -> Column:
    formal = F.lower(F.get(said, F.lit(0))).isin("house", "senate", "joint") & (F.lower(F.get(said, F.lit(1))) == "committee") & (F.lower(F.get(said, F.lit(2))) == "on")
    formal = F.coalesce(formal & (F.length(F.get(said, F.lit(3))) > 0), F.lit(False))
    chamber = F.when(formal, F.try_element_at(F.create_map(F.lit("house"), F.lit("H"), F.lit("senate"), F.lit("S")), F.lower(F.get(said, F.lit(0)))))
    return F.struct(chamber.alias("chamber"), F.when(formal, F.get(said, F.lit(3))).otherwise(place).alias("committee"))


def note_label(description: Column, current_biennium: str) -> Column:
    """Struct (label, kind, amendment) of a prior note's description: the bill's short label or else the description
    before a closing "(Final)", "(Partial)" or "(Revised)", which is its kind, and the amendment that it is about."""
    text = F.trim(description)
    open_ = F.instr(F.reverse(text), F.lit("("))
    last = F.initcap(F.substring_index(F.substr(text, F.length(text) - open_ + 2), ")", 1))
    closes = F.coalesce(F.endswith(text, F.lit(")")) & (open_ > 0) & last.isin("Final", "Partial", "Revised"), F.lit(False))
    head = F.when(closes, F.trim(F.substr(text, F.lit(1), F.length(text) - open_))).otherwise(text)
    ref = refs.parse_column(head, current_biennium)
    bill = ref["kind"] == "bill"
    label = F.when(bill, refs.labels_column(ref["type"], ref["number"], F.coalesce(ref["version_code"], F.lit("I")), ref["biennium"])["short"]).otherwise(head)
    after = F.element_at(F.transform(F.array(F.split(F.regexp_replace(head, r"\s+", " "), " ", 3)), lambda w: F.get(w, F.lit(2))), 1)
    return F.struct(label.alias("label"), F.when(closes, last).alias("kind"), F.when(bill & ref["drafter_number"].isNotNull(), after).alias("amendment"))
