"""Version diffs: lines aligned by Myers' shortest edit script, then words within paired lines; sections by identity.

All sections of a pair of versions are aligned together; those of equal hashes are not diffed by line.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shared characters over the longer line for a pair to count as changed; similarity of sections, and of those with the same number.
PAIRED, SIMILAR, SAME_PLACE = 0.4, 0.6, 0.3
Op = tuple[str, int, int]


def _middle(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """Ends (x, y, u, v) of a run of equal symbols, perhaps empty, on a shortest way from the starts to the ends of a and b.

    Furthest points are followed from both sides at once, two rows of diagonals in all; where they first meet, half of
    the edits lie on either side.
    """
    n, m = len(a), len(b)
    delta, most = n - m, (n + m + 1) // 2
    size = 2 * most + 2
    fore, back = [0] * size, [0] * size
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = fore[k + 1] if k == -d or (k != d and fore[k - 1] < fore[k + 1]) else fore[k - 1] + 1
            x0 = x
            y0 = y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            fore[k] = x
            if delta % 2 and -(d - 1) <= delta - k <= d - 1 and x + back[delta - k] >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            x0 = x
            y0 = y = x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta % 2 and -d <= delta - k <= d and x + fore[delta - k] >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("the ways meet")


def myers(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[Op]:
    """Shortest edit script as (equal | delete | insert, start, end) runs; starts are in `a` for equal and delete.

    Symbols are numbers first. The problem is halved at a middle run again and again, so memory grows with the length
    alone; symbols that only one side has, and sides whose common symbols stand in one order, are settled before.
    """
    numbers: dict[Hashable, int] = {}
    one, two = ([numbers.setdefault(x, len(numbers)) for x in side] for side in (a, b))
    steps: list[tuple[str, int, int]] = []
    todo: list[tuple] = [(0, len(one), 0, len(two), None)]
    while todo:
        i, j, u, v, run = todo.pop()
        if run is not None:
            steps += [("equal", i + t, u + t) for t in range(run)]
            continue
        front = 0
        while i < j and u < v and one[i] == two[u]:
            steps.append(("equal", i, u))
            i, u = i + 1, u + 1
        while j - front > i and v - front > u and one[j - 1 - front] == two[v - 1 - front]:
            front += 1
        if front:
            j, v = j - front, v - front
            todo.append((j, j + front, v, v + front, front))
        shared = set(one[i:j]) & set(two[u:v]) if i < j and u < v else ()
        xs, ys = [x for x in range(i, j) if one[x] in shared], [y for y in range(u, v) if two[y] in shared]
        if [one[x] for x in xs] == [two[y] for y in ys]:
            # What both sides have stands in one order: all of it is equal, and the rest goes and comes between.
            for x, y in [*zip(xs, ys, strict=True), (j, v)]:
                steps += [("delete", k, u) for k in range(i, x)] + [("insert", x, k) for k in range(u, y)]
                if x < j:
                    steps.append(("equal", x, y))
                i, u = x + 1, y + 1
            continue
        x, y, to_x, to_y = _middle(one[i:j], two[u:v])
        todo += [(i + to_x, j, u + to_y, v, None), (i + x, i + to_x, u + y, u + to_y, to_x - x), (i, i + x, u, u + y, None)]
    return _grouped(steps)


def _grouped(steps: list[tuple[str, int, int]]) -> list[Op]:
    """Runs of steps; between two equal runs deletions come before insertions."""
    out: list[Op] = []
    held: dict[str, list[int]] = {"delete": [], "insert": []}

    def flush() -> None:
        for mark in ("delete", "insert"):
            if held[mark]:
                out.append((mark, held[mark][0], held[mark][-1] + 1))
                held[mark] = []

    for mark, x, y in steps:
        if mark == "equal":
            flush()
            if out and out[-1][0] == "equal" and out[-1][2] == x:
                out[-1] = ("equal", out[-1][1], x + 1)
            else:
                out.append(("equal", x, x + 1))
        else:
            held[mark].append(x if mark == "delete" else y)
    flush()
    return out


def words_of(line: str) -> list[str]:
    """Words and single blanks: other white space never shows as a change."""
    return re.findall(r"\s+|\w+|[^\w\s]", re.sub(r"\s+", " ", line).strip())


def spans(before: str, after: str) -> list[tuple[str, str]]:
    """(mark, text) of a word diff."""
    return _spans(words_of(before), words_of(after))


def _spans(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    return [(mark, "".join((b if mark == "insert" else a)[i:j])) for mark, i, j in myers(a, b)]


def paired_spans(old: str, new: str) -> list[tuple[str, str]] | None:
    """The word diff of two lines that share enough characters to be one changed line; else none.

    Words that both have, in whatever order, bound what can be shared, and most unlike lines aren't diffed at all.
    """
    least = PAIRED * max(len(old), len(new), 1)
    a, b = words_of(old), words_of(new)
    common = Counter(a) & Counter(b)
    if sum(len(w) * n for w, n in common.items()) < least:
        return None
    parts = _spans(a, b)
    return parts if sum(len(t) for m, t in parts if m == "equal") >= least else None


def is_paired(old: str, new: str) -> bool:
    """Whether `paired_spans` has a diff. Words that both begin or end with are equal in it, and mostly suffice."""
    least = PAIRED * max(len(old), len(new), 1)
    a, b = words_of(old), words_of(new)
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        least -= len(a[n])
        n += 1
    m = 1
    while m <= most - n and a[-m] == b[-m]:
        least -= len(a[-m])
        m += 1
    return least <= 0 or paired_spans(old, new) is not None


#: Ways to read a bill: with its own marks of amended text, or as it would read in law.
MODES = ("as-printed", "effect")


def reading_lines(paragraphs: Sequence[dict], mode: str = "as-printed") -> list[tuple]:
    """Lines to align, as tuples of kind, depth and marked words, from paragraphs (depth, kind, label, label_mark, runs).

    Runs are (t, text); `t` ins and del are the bill's own marks. As printed, a word differs from the same word with
    another mark; in effect struck runs and labels aren't there and nothing is marked. White space between words is one
    blank, whatever it was; lines without words are left out. Runs of a table's row are parted by " | ".
    """
    out = []
    for p in paragraphs:
        runs = [{"t": p.get("label_mark") or "text", "text": p["label"] + " "}] if p.get("label") else []
        words: list[tuple[str, str]] = []
        for r in [*runs, *p["runs"]]:
            mark = r["t"] if r["t"] in ("ins", "del") else ""
            if mode == "effect" and mark == "del":
                continue
            for piece in re.findall(r"\s+|\S+", r["text"]):
                if not piece.isspace():
                    words.append(("" if mode == "effect" else mark, piece))
                elif words and words[-1][1] != " ":
                    words.append(("", " "))
        while words and words[-1][1] == " ":
            words.pop()
        if words:
            out.append((p.get("kind", "text"), p.get("depth", 1), tuple(words)))
    return out


def diff_reading(before: Sequence[dict], after: Sequence[dict], mode: str = "as-printed") -> list[tuple[str, str]]:
    """(mark, line) of two sections' paragraphs in a mode: lines that differ in kind, depth or marks are different lines."""
    a, b = reading_lines(before, mode), reading_lines(after, mode)
    text = lambda line: "".join(w for _, w in line[2])
    return [(mark, text(x)) for mark, i, j in myers(a, b) for x in (b if mark == "insert" else a)[i:j]]


def diff_lines(before: Sequence[str], after: Sequence[str]) -> list[dict]:
    """Lines with marks equal, changed, delete or insert; the i-th deleted line of a run is paired with the i-th inserted."""
    a, b = [" ".join(x.split()) for x in before], [" ".join(x.split()) for x in after]
    whole = lambda mark, text: {"mark": mark, "spans": [(mark, text)]}
    out: list[dict] = []
    ops = myers(a, b)
    at = 0
    while at < len(ops):
        mark, i, j = ops[at]
        paired = mark == "delete" and at + 1 < len(ops) and ops[at + 1][0] == "insert"
        if not paired:
            out += [whole(mark, x) for x in (b if mark == "insert" else a)[i:j]]
            at += 1
            continue
        removed, added = a[i:j], b[ops[at + 1][1] : ops[at + 1][2]]
        for old, new in zip(removed, added, strict=False):
            parts = paired_spans(old, new)
            out += [{"mark": "changed", "spans": parts}] if parts else [whole("delete", old), whole("insert", new)]
        n = min(len(removed), len(added))
        out += [whole("delete", x) for x in removed[n:]] + [whole("insert", x) for x in added[n:]]
        at += 2
    return out


def count_lines(before: Sequence[str], after: Sequence[str]) -> tuple[int, int, int]:
    """Lines that `diff_lines` marks as changed, insert and delete; where one side has none, nothing is aligned."""
    if not before or not after:
        return 0, len(after), len(before)
    a, b = [" ".join(x.split()) for x in before], [" ".join(x.split()) for x in after]
    changed = inserted = deleted = 0
    removed: list[str] = []
    for mark, i, j in [*myers(a, b), ("equal", 0, 0)]:
        if mark == "delete":
            removed = a[i:j]
            deleted += j - i
            continue
        if mark == "insert":
            inserted += j - i
            changed += sum(is_paired(old, new) for old, new in zip(removed, b[i:j], strict=False))
        removed = []
    return changed, inserted - changed, deleted - changed


def rebuilt(lines: Sequence[dict], side: str) -> list[str]:
    """The text of one side from a diff: `insert` rebuilds the later one, `delete` the earlier one."""
    return ["".join(t for m, t in x["spans"] if m in ("equal", side)) for x in lines if x["mark"] in ("equal", "changed", side)]


def similarity(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x or y else 1.0


def similar_sections(before: dict[int, str], after: dict[int, str]) -> list[tuple[int, int, float]]:
    """(place after, place before, similarity) of all pairs that reach SIMILAR, the most similar first.

    Such a pair shares one of the rarest words of either side, as many as may be missing and one more, so only pairs
    that do are compared.
    """
    sets = {(side, k): frozenset(t.lower().split()) for side, texts in enumerate((before, after)) for k, t in texts.items()}
    often = Counter(w for words in sets.values() for w in words)
    prefix = lambda words: sorted(words, key=lambda w: (often[w], w))[: len(words) - math.ceil(SIMILAR * len(words)) + 1]
    holders: dict[str, list[int]] = {}
    for (side, k), words in sets.items():
        if side == 0:
            for w in prefix(words) or [""]:
                holders.setdefault(w, []).append(k)
    met = {(j, i) for (side, j), words in sets.items() if side == 1 for w in prefix(words) or [""] for i in holders.get(w, [])}
    scored = [(j, i, similarity(after[j], before[i])) for j, i in met]
    return sorted((x for x in scored if x[2] >= SIMILAR), key=lambda x: (-x[2], x[0], x[1]))


def align_sections(before: Sequence[dict], after: Sequence[dict]) -> list[tuple[int | None, int | None]]:
    """(place before, place after) of each section, in reading order of the later version with removed ones before
    what followed them. Sections match by identity, then by similarity, best first, then by number and kind."""
    first: dict[str, int] = {}
    for i, s in enumerate(before):
        first.setdefault(s["identity"], i)
    match: dict[int, int] = {}
    used: set[int] = set()

    def join(j: int, i: int) -> None:
        if j not in match and i not in used:
            match[j] = i
            used.add(i)

    for j, s in enumerate(after):
        i = first.get(s["identity"])
        if i is not None and i not in used:
            match[j] = i
            used.add(i)
    free = lambda: [i for i in range(len(before)) if i not in used]
    # Both sides have sections left.
    both = len(match) < min(len(before), len(after))
    for j, i, _ in similar_sections({i: before[i]["text"] for i in free()}, {j: after[j]["text"] for j in range(len(after)) if j not in match}) if both else ():
        join(j, i)
    by_place: dict[tuple, list[int]] = {}
    for i in free() if both else ():
        by_place.setdefault((before[i]["num"], before[i]["kind"]), []).append(i)
    for j in range(len(after)) if both else ():
        if j not in match:
            same = (i for i in by_place.get((after[j]["num"], after[j]["kind"]), []) if i not in used and similarity(after[j]["text"], before[i]["text"]) >= SAME_PLACE)
            if (i := next(same, None)) is not None:
                join(j, i)
    out: list[tuple[int | None, int | None]] = []
    gone, at = free() if len(used) < len(before) else [], 0
    for j in range(len(after)):
        own = match.get(j)
        while own is not None and at < len(gone) and gone[at] < own:
            out.append((gone[at], None))
            at += 1
        out.append((own, j))
    return out + [(i, None) for i in gone[at:]]


def _status(old: dict | None, new: dict | None, edits: bool) -> str:
    return "added" if old is None else "removed" if new is None else "changed" if edits else "renumbered" if old["num"] != new["num"] else "equal"


def _sides(old: dict | None, new: dict | None) -> tuple[list[str], list[str]]:
    """Lines of both sides of an aligned section; none where hashes are equal, as nothing is diffed then."""
    if old and new and old["text_hash"] == new["text_hash"]:
        return [], []
    return old["text"].splitlines() if old else [], new["text"].splitlines() if new else []


def diff_sections(before: Sequence[dict], after: Sequence[dict]) -> list[dict]:
    """For each aligned section its status, counts and lines. Sections have identity, num, kind, text and text_hash."""
    out = []
    for i, j in align_sections(before, after):
        old, new = (None if i is None else before[i]), (None if j is None else after[j])
        lines = diff_lines(*_sides(old, new))
        count = {m: sum(x["mark"] == m for x in lines) for m in ("changed", "insert", "delete")}
        status = _status(old, new, any(count.values()))
        out.append({"identity": (new or old)["identity"], "from_num": old and old["num"], "to_num": new and new["num"], "status": status, "changed": count["changed"], "inserted": count["insert"], "deleted": count["delete"], "lines": lines if status not in ("equal", "renumbered") else []})
    return out


def count_sections(before: Sequence[dict], after: Sequence[dict]) -> Iterator[tuple]:
    """(identity, from_num, to_num, status, changed, inserted, deleted) of `diff_sections`, without the lines."""
    for i, j in align_sections(before, after):
        old, new = (None if i is None else before[i]), (None if j is None else after[j])
        if old is None:
            yield new["identity"], None, new["num"], "added", 0, len(new["text"].splitlines()), 0
        elif new is None:
            yield old["identity"], old["num"], None, "removed", 0, 0, len(old["text"].splitlines())
        else:
            counts = (0, 0, 0) if old["text_hash"] == new["text_hash"] else count_lines(*_sides(old, new))
            yield new["identity"], old["num"], new["num"], _status(old, new, any(counts)), *counts


LINES = "n_equal int, n_changed int, n_inserted int, n_deleted int"


#: What ends a line.
ENDS = "\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def line_diff_columns(df: DataFrame, before: str, after: str) -> DataFrame:
    """All columns plus counts of the line diff of two texts; null is an empty text. Equal texts are settled without Python."""

    @F.pandas_udf(LINES)
    def counted(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        none = [0, 0, 0, 0]
        marks = [None if p is None else Counter(x["mark"] for x in diff_lines(p.splitlines(), q.splitlines())) for p, q in zip(a, b, strict=True)]
        rows = [none if m is None else [m["equal"], m["changed"], m["insert"], m["delete"]] for m in marks]
        return pd.DataFrame(rows, columns=["n_equal", "n_changed", "n_inserted", "n_deleted"], dtype="int32")

    one, two = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    same = one == two
    pieces = F.split(one, ENDS)
    number = F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    zero = F.lit(0)
    own = F.struct(number.cast("int").alias("n_equal"), zero.alias("n_changed"), zero.alias("n_inserted"), zero.alias("n_deleted"))
    rows = df.withColumn("_same", same).withColumn("_d", counted(F.when(~same, one), F.when(~same, two)))
    return rows.withColumn("_d", F.when(F.col("_same"), own).otherwise(F.col("_d"))).select(*df.columns, "_d.*")


def diff_versions(sections: DataFrame, frm: str, to: str) -> DataFrame:
    """Section diffs of two versions of every bill, from (bill_key, version_code, ordinal, identity, num, kind, text, text_hash).

    A bill's sections travel as one array, many bills to a batch, and are read and written column by column.
    """
    schema = "bill_key string, place int, identity string, from_num int, to_num int, status string, changed int, inserted int, deleted int"
    shape = pa.schema([(n, pa.string() if t == "string" else pa.int32()) for n, t in (field.split() for field in schema.split(", "))])
    names = ["identity", "num", "kind", "text", "text_hash"]
    row = F.struct("ordinal", "version_code", *names)

    def diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], 0
            flat = batch.column(1).flatten()
            codes, *columns = (flat.field(n).to_pylist() for n in ("version_code", *names))
            sections = [dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True)]
            for bill, n in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist(), strict=True):
                before, after = ([sections[k] for k in range(at, at + n) if codes[k] == code] for code in (frm, to))
                out += [(bill, i, *d) for i, d in enumerate(count_sections(before, after))]
                at += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    both = sections.where(F.col("version_code").isin(frm, to)).groupBy("bill_key").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return both.mapInArrow(diffs, schema)


def summary(diffs: DataFrame) -> DataFrame:
    """Totals for each bill; a renumbered section counts as changed."""
    return diffs.groupBy("bill_key").agg(F.sum("changed").alias("changed"), F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted"), F.count_if(F.col("status") != "equal").alias("sections_changed"))


def sentence(changed: Column, inserted: Column, deleted: Column) -> Column:
    """What a diff amounts to, as "2 lines changed, 1 line added"; null counts are 0."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " line ").otherwise(" lines "), F.lit(what)))
    said = F.concat_ws(", ", part(changed, "changed"), part(inserted, "added"), part(deleted, "removed"))
    return F.when(said == "", "No changes").otherwise(said)


def redline(lines: Sequence[dict]) -> str:
    """A diff's lines as HTML: a paragraph for each, classed by its mark, what came in in <ins> and what went out in <del>."""
    put = {"insert": "ins", "delete": "del"}

    def shown(mark: str, text: str) -> str:
        safe = html.escape(text, quote=False)
        return f"<{put[mark]}>{safe}</{put[mark]}>" if mark in put else safe

    return "".join(f'<p class="diff-line diff-line--{x["mark"]}">{"".join(shown(m, t) for m, t in x["spans"])}</p>' for x in lines)


def redline_columns(df: DataFrame, before: str, after: str, name: str = "redline") -> DataFrame:
    """All columns plus the diff of two texts as HTML; null is an empty text."""

    @F.pandas_udf("string")
    def marked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([redline(diff_lines(p.splitlines(), q.splitlines())) for p, q in zip(a, b, strict=True)], dtype=object)

    return df.withColumn(name, marked(F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))))


def with_striking(sections: DataFrame, amendments: DataFrame) -> DataFrame:
    """Sections of versions and, as further versions named by their drafter's number, of striking amendments.

    `amendments` is like `sections`, with drafter_number and striking instead of version_code; others are left out.
    """
    own = amendments.where("striking").withColumn("version_code", F.concat(F.lit("AMD:"), "drafter_number"))
    return sections.unionByName(own.select(*sections.columns))
