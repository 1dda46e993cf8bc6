"""Note documents as flattened trees: text, slots, estimate facts and the rules that reconcile them.

A document is a tree of nodes (type, attrs, content, text). `flatten` gives rows in pre-order, with parents and depth,
on which the rules are ordinary aggregations and joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.formula import evaluate, key_of, number
from docketry.operators.relational import pair_sum

# Tolerances of money and of staff.
MONEY_EPS, STAFF_EPS = 0.5, 0.051
# Roles of a note's tables.
ACCOUNTS, RECEIPTS, OBJECTS, CLASSES, TEN_YEARS = "expenditures-by-account", "cash-receipts", "expenditures-by-object", "fte-by-class", "ten-year-analysis"
#: Rows that aren't entries of a table, and fiscal years that rules look at.
NO_ENTRY, YEARS = ("total", "fte", "footer"), 6


def walk(node: dict[str, Any], parent: int | None = None, depth: int = 0, rows: list | None = None) -> list[dict]:
    """Nodes in pre-order: pre, parent, depth, type, attrs and own text."""
    rows = [] if rows is None else rows
    me = len(rows)
    attrs = {k: v for k, v in (node.get("attrs") or {}).items() if v is not None}
    rows.append({"pre": me, "parent": parent, "depth": depth, "type": node["type"], "attrs": {k: json.dumps(v) if isinstance(v, bool | dict | list) else str(v) for k, v in attrs.items()}, "text": node.get("text")})
    for child in node.get("content") or []:
        walk(child, me, depth + 1, rows)
    return rows


def node_text(node: dict[str, Any]) -> str:
    return (node.get("text") or "") + "".join(map(node_text, node.get("content") or []))


def flatten(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pre, parent, depth, type, attrs, text) of JSON documents; nulls have no nodes."""
    shape = pa.schema([("key", pa.string()), ("pre", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("type", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"key": k, **r, "attrs": list(r["attrs"].items())} for k, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if doc for r in walk(json.loads(doc))]
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return docs.select(F.col(key).cast("string"), F.col(column)).mapInArrow(nodes, "key string, pre int, parent int, depth int, type string, attrs map<string,string>, text string")


def document_text(nodes: DataFrame) -> DataFrame:
    """The text of each document, in order."""
    parts = F.array_sort(F.collect_list(F.struct("pre", "text")))
    return nodes.where("text IS NOT NULL").groupBy("key").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def comment_places(nodes: DataFrame, attr: str = "comment") -> DataFrame:
    """(key, comment, at): where each comment's first mark stands, counted in characters, one for a node without text."""
    from pyspark.sql import Window

    size = F.when(F.col("text").isNull(), 1).otherwise(F.length("text"))
    before = F.sum(size).over(Window.partitionBy("key").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)) - size
    return nodes.withColumn("at", before).where(F.col("attrs")[attr].isNotNull()).groupBy("key", F.col("attrs")[attr].alias("comment")).agg(F.min("at").alias("at"))


def slots(doc: dict[str, Any]) -> list[dict]:
    """Slots in order: path, whether required and filled. What a slot holds is its own; a hint is no filling."""
    attrs = doc.get("attrs") or {}
    if attrs.get("slot") and doc["type"] in ("slot", "noteCell", "checkbox"):
        text = node_text(doc).strip()
        filled = doc["type"] == "checkbox" or (text != "" and text != str(attrs.get("hint") or "").strip())
        return [{"slot": attrs["slot"], "required": bool(attrs.get("required")), "filled": filled, "computed": attrs.get("computed")}]
    return [s for child in doc.get("content") or [] for s in slots(child)]


def slot_values(doc: dict[str, Any]) -> dict[str, Any]:
    """Values by path: a checkbox's state, a cell's stored value, else its text."""
    out: dict[str, Any] = {}
    attrs = doc.get("attrs") or {}
    if attrs.get("slot"):
        value = attrs.get("value")
        out[key_of(attrs["slot"])] = bool(attrs.get("checked")) if doc["type"] == "checkbox" else float(value) if isinstance(value, int | float) else node_text(doc).strip() or None
    for child in doc.get("content") or []:
        out |= slot_values(child)
    return out


@lru_cache(1 << 10)
def _year(place: str) -> int | None:
    """The fiscal year that a column or slot ends with."""
    m = re.search(r"fy(\d+)$", place)
    return int(m[1]) if m else None


def row_facts(row: dict[str, Any]) -> list[tuple]:
    """(row_kind, row_key, fy, value) of the numeric cells of a table's row; headers have none."""
    a = row.get("attrs") or {}
    if row["type"] != "noteRow" or a.get("header"):
        return []
    kind = a.get("rowKind") or ("footer" if a.get("footer") else "row")
    key = str(a.get("key") or a.get("account") or a.get("object") or "")
    out = []
    for cell in row.get("content") or []:
        c = cell.get("attrs") or {}
        year = _year(str(c.get("col") or c.get("slot") or ""))
        if year is not None:
            value = c["value"] if isinstance(c.get("value"), int | float) else number(node_text(cell).strip() or None)
            out.append((kind, key, year, None if value is None else float(value)))
    return out


def role_of(table: dict[str, Any]) -> str:
    return str((table.get("attrs") or {}).get("role") or "")


def facts(doc: dict[str, Any]) -> list[tuple]:
    """(part, row_kind, row_key, fy, value) of the numeric cells of a document's tables, by the table's role."""
    if doc["type"] == "noteTable":
        role = role_of(doc)
        return [(role, *f) for row in doc.get("content") or [] for f in row_facts(row)]
    return [f for child in doc.get("content") or [] for f in facts(child)]


#: How a row begins where it is told from the rest of a text, rows and frames that a task keeps, and their longest.
ROW, KEPT_ROWS, KEPT_FRAMES, KEPT_LENGTH = '{"type":"noteRow",', 1 << 14, 1 << 8, 1 << 12


def fact_reader() -> Callable[[str], list[tuple]]:
    """`facts` of JSON texts, for which rows that look alike are read once, and so are the frames that are left without rows.

    A row's beginning can't stand inside a JSON string, whose quotes are escaped. Where rows don't stand in tables alone,
    one holds another, or a text is written in another way, the whole text is read.
    """
    decode = json.JSONDecoder().raw_decode

    def row(text: str) -> tuple[list[tuple], str]:
        """Facts of the row that a text goes on with, and what follows it."""
        node, end = decode(ROW + text)
        return row_facts(node), text[end - len(ROW) :]

    def frame(text: str) -> list[str | None]:
        """The role of each table around a row that was taken out, in order; None for rows that were left, or stand elsewhere."""

        def roles(node: Any) -> list[str | None]:
            if node == []:
                return [None]
            if node["type"] == "noteTable":
                return [role_of(node) if child == [] else None for child in node.get("content") or [] if child == [] or child["type"] == "noteRow"]
            return [r for child in node.get("content") or [] for r in roles(child)]

        return roles(json.loads(text))

    kept_row, kept_frame = lru_cache(KEPT_ROWS)(row), lru_cache(KEPT_FRAMES)(frame)

    def read(text: str) -> list[tuple]:
        head, *rest = text.split(ROW)
        try:
            rows = [(kept_row if len(r) <= KEPT_LENGTH else row)(r) for r in rest]
            bare = "[]".join([head, *[after for _, after in rows]])
            roles = (kept_frame if len(bare) <= KEPT_LENGTH else frame)(bare)
        except (ValueError, ArithmeticError, LookupError, TypeError, AttributeError):
            return facts(json.loads(text))  # what is an error there is one
        if len(roles) != len(rows) or None in roles:
            return facts(json.loads(text))
        return [(role, *f) for role, (own, _) in zip(roles, rows, strict=True) for f in own]

    return read


FACTS = [("part", "string"), ("row_kind", "string"), ("row_key", "string"), ("fy", "int"), ("value", "double")]
PAIRS = [*FACTS[:3], ("bien", "int"), ("a", "double"), ("b", "double")]


def _read(docs: DataFrame, key: str, column: str, fields: list[tuple[str, str]], shown: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """doc_id and the fields of what is shown of each JSON document's facts; nulls have none."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = fact_reader()
        for batch in batches:
            out, own = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    rows = shown(read(text))
                    out += rows
                    own += [n] * len(rows)
            if out:
                columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int32())), *columns], ["doc_id", *[name for name, _ in fields]])

    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(column)).mapInArrow(found, ", ".join(map(" ".join, [("doc_id", "string"), *fields])))


def fact_table(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(doc_id, part, row_kind, row_key, fy, value) of JSON documents."""
    return _read(docs, key, column, FACTS, lambda found: found)


def paired(found: list[tuple]) -> list[tuple]:
    """A document's facts by pairs of fiscal years: (part, row_kind, row_key, bien, sum of the odd year, of the even one)."""
    sums: dict[tuple, list[float | None]] = {}
    for part, kind, key, fy, value in found:
        pair = sums.setdefault((part, kind, key, (fy + 1) // 2), [None, None])
        if value is not None:
            at = 1 - fy % 2
            pair[at] = value if pair[at] is None else pair[at] + value
    return [(*k, *pair) for k, pair in sums.items()]


def _biennium(pairs: DataFrame) -> DataFrame:
    total = pair_sum(F.col("a"), F.col("b"))
    return pairs.select("doc_id", "part", "row_kind", "row_key", "bien", F.when((F.col("part") == CLASSES) | (F.col("row_kind") == "fte"), total / 2).otherwise(total).alias("value"))


def biennia(facts: DataFrame) -> DataFrame:
    """Sums of each pair of fiscal years; staff is an average of the two."""
    pair = facts.withColumn("bien", F.ceil(F.col("fy") / 2).cast("int")).groupBy("doc_id", "part", "row_kind", "row_key", "bien")
    return _biennium(pair.agg(F.sum(F.when(F.col("fy") % 2 == 1, F.col("value"))).alias("a"), F.sum(F.when(F.col("fy") % 2 == 0, F.col("value"))).alias("b")))


def document_biennia(docs: DataFrame, key: str, column: str) -> DataFrame:
    """`biennia` of JSON documents, each of which has a key of its own: summed where they are read, and not dealt out again."""
    return _biennium(_read(docs, key, column, PAIRS, paired))


def ten_year(facts: DataFrame) -> DataFrame:
    return facts.where("fy BETWEEN 1 AND 10").groupBy("doc_id", "part", "row_key").agg(F.sum("value").alias("total"))


def off_by(a: Column, b: Column, eps: float) -> Column:
    return F.abs(a - b) > F.lit(eps)


def entries(part: str) -> Column:
    """Values of a table's entries alone."""
    return F.when((F.col("part") == part) & ~F.col("row_kind").isin(*NO_ENTRY), F.col("value"))


def total_errors(facts: DataFrame) -> DataFrame:
    """Total cells of accounts and receipts that differ from the sum of their entries, none being 0: (doc_id, part, fy, stated, summed)."""
    own = facts.where(F.col("part").isin(ACCOUNTS, RECEIPTS))
    by = own.groupBy("doc_id", "part", "fy").agg(F.sum(F.when(F.col("row_kind") == "total", F.col("value"))).alias("stated"), F.coalesce(F.sum(F.when(~F.col("row_kind").isin(*NO_ENTRY), F.col("value"))), F.lit(0.0)).alias("summed"))
    return by.where(off_by(F.col("stated"), F.col("summed"), MONEY_EPS))


def object_errors(facts: DataFrame) -> DataFrame:
    """Years whose expenditures differ from the objects, where a document has both tables: (doc_id, fy, stated, summed).

    A year that one of them leaves out counts as 0 there.
    """
    both = facts.where(F.col("part").isin(ACCOUNTS, OBJECTS) & ~F.col("row_kind").isin(*NO_ENTRY))
    has = both.groupBy("doc_id").agg(F.count_distinct("part").alias("n")).where("n = 2").select("doc_id")
    by = both.where(F.col("fy").between(1, YEARS)).groupBy("doc_id", "fy").agg(F.coalesce(F.sum(entries(ACCOUNTS)), F.lit(0.0)).alias("stated"), F.coalesce(F.sum(entries(OBJECTS)), F.lit(0.0)).alias("summed"))
    return by.join(has, "doc_id", "left_semi").where(off_by(F.col("stated"), F.col("summed"), MONEY_EPS))


def staff_errors(facts: DataFrame) -> DataFrame:
    """Staff cells beside the accounts that differ from the sum of the classes, where both are given: (doc_id, fy, stated, summed)."""
    stated = F.sum(F.when((F.col("part") == ACCOUNTS) & (F.col("row_kind") == "fte"), F.col("value")))
    by = facts.where(F.col("fy").between(1, YEARS)).groupBy("doc_id", "fy").agg(stated.alias("stated"), F.sum(entries(CLASSES)).alias("summed"))
    return by.where(off_by(F.col("stated"), F.col("summed"), STAFF_EPS))


def computed_errors(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Computed cells that don't show what their expression yields: (doc_id, code, path, expected, actual).

    An expression that yields no number is passed over. Staff and averages may be STAFF_EPS off, all else MONEY_EPS; a
    blank cell is an error.
    """
    shape = pa.schema([("doc_id", pa.string()), ("code", pa.string()), ("path", pa.string()), ("expected", pa.float64()), ("actual", pa.float64())])

    def errors(doc: dict[str, Any], name: str) -> Iterator[dict]:
        values = slot_values(doc)
        for table in nodes_of(doc, "noteTable"):
            own = table.get("attrs") or {}
            for row in table.get("content") or []:
                at = row.get("attrs") or {}
                for cell in row.get("content") or []:
                    c = cell.get("attrs") or {}
                    rule = c.get("computed")
                    expected = evaluate(rule, values) if rule else None
                    if isinstance(expected, bool) or not isinstance(expected, int | float):
                        continue
                    actual = c["value"] if isinstance(c.get("value"), int | float) else number(node_text(cell).strip() or None)
                    average = rule.startswith("avg(")
                    eps = STAFF_EPS if average or c.get("slotType") == "fte" or own.get("unit") == "fte" else MONEY_EPS
                    if actual is None or abs(actual - expected) > eps:
                        code = "fte_biennium_average" if average else "biennium_sum" if rule.startswith("sum(") and "," in rule and "*" not in rule else "computed_mismatch"
                        path = "/".join(str(x or "") for x in (own.get("role"), at.get("key") or at.get("rowKind"), c.get("col")))
                        yield {"doc_id": name, "code": code, "path": path, "expected": float(expected), "actual": None if actual is None else float(actual)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([e for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if d for e in errors(json.loads(d), k)], schema=shape)

    return docs.select(F.col(key).cast("string"), F.col(column)).mapInArrow(rows, "doc_id string, code string, path string, expected double, actual double")


def nodes_of(node: dict[str, Any], kind: str) -> Iterator[dict[str, Any]]:
    """Nodes of a kind in pre-order."""
    if node["type"] == kind:
        yield node
    for child in node.get("content") or []:
        yield from nodes_of(child, kind)


def fiscal_years(headers: Column, as_of_year: Column) -> Column:
    """Ten fiscal years from the first that a table's header names, where it names two or more; else from the year after.

    `headers` holds an array of header texts for each table. Null headers, and those without years, name none.
    """
    named = F.transform(headers, lambda cells: F.flatten(F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda c: F.transform(F.slice(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"FY\s*(\d{4})"), F.lit(1)), 1, 1), lambda y: y.cast("int")))))
    first = F.get(F.get(F.filter(named, lambda years: F.size(years) >= 2), F.lit(0)), F.lit(0))
    start = F.coalesce(first, as_of_year.cast("int") + 1)
    return F.sequence(start, start + 9)


def biennia_of(years: Column) -> Column:
    """Labels of the three biennia that hold the years: the first begins the year before them."""
    start = F.get(years, F.lit(0)) - 1
    return F.transform(F.array(F.lit(0), F.lit(2), F.lit(4)), lambda n: F.concat((start + n).cast("string"), F.lit("-"), F.lpad(((start + n + 2) % 100).cast("string"), 2, "0")))
