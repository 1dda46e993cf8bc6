import itertools
import random
from unittest import mock

import pytest
from pyspark.sql import functions as F

from docketry.functions.text import format_number
from docketry.operators import diff, formula, relational, workflow


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_edit_scripts_are_shortest_and_rebuild_both_sides():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 10))] for _ in range(2))
        ops = diff.myers(a, b)
        assert [x for m, i, j in ops for x in (b if m == "insert" else a)[i:j] if m != "insert"] == a
        assert [x for m, i, j in ops if m != "delete" for x in (b if m == "insert" else a)[i:j]] == b
        assert sum(j - i for m, i, j in ops if m == "equal") == longest(a, b)
        lines = diff.diff_lines(["".join(a), "x"], ["".join(b), "y"])
        assert diff.rebuilt(lines, "insert") == ["".join(b), "y"] and diff.rebuilt(lines, "delete") == ["".join(a), "x"]


def test_long_scripts_need_little_memory():
    import tracemalloc

    rnd = random.Random(5)
    a = [rnd.randint(0, 50) for _ in range(1500)]
    b = [x if rnd.random() < 0.7 else rnd.randint(0, 50) for x in a]
    tracemalloc.start()
    ops = diff.myers(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000 and sum(j - i for m, i, j in ops if m == "equal") == longest(a, b)


def test_lines_that_are_not_paired_are_not_diffed():
    rnd = random.Random(6)
    for _ in range(300):
        old, new = (" ".join(rnd.choice("tax fee levy of the a".split()) for _ in range(rnd.randint(0, 12))) for _ in range(2))
        parts = diff.spans(old, new)
        near = sum(len(t) for m, t in parts if m == "equal") >= diff.PAIRED * max(len(old), len(new), 1)
        assert diff.paired_spans(old, new) == (parts if near else None)


def test_modes_of_reading():
    run = lambda t, text: {"t": t, "text": text}
    before = [{"runs": [run("text", "The tax is  "), run("del", "((five)) "), run("ins", "six"), run("text", " dollars.")]}, {"label": "(1)", "depth": 2, "runs": [run("text", "Same")]}, {"runs": [run("del", "gone")]}]
    after = [{"runs": [run("text", "The tax is six dollars.")]}, {"label": "(1)", "label_mark": "ins", "depth": 2, "runs": [run("text", "Same ")]}]
    assert diff.diff_reading(before, after, "effect") == [("equal", "The tax is six dollars."), ("equal", "(1) Same")]
    printed = diff.diff_reading(before, after)
    assert [m for m, _ in printed] == ["delete", "delete", "delete", "insert", "insert"] and printed[0][1] == "The tax is ((five)) six dollars." and printed[2][1] == "gone"
    assert diff.diff_reading(before, before) == [("equal", t) for t in ("The tax is ((five)) six dollars.", "(1) Same", "gone")]


def test_redlines(spark):
    df = spark.createDataFrame([("The tax is five.\nSame & old", "The tax is <six>.\nSame & old"), (None, "new"), ("", None)], "a string, b string")
    got = [r["redline"] for r in diff.redline_columns(df, "a", "b").collect()]
    assert got[0] == '<p class="diff-line diff-line--changed">The tax is <del>five</del><ins>&lt;six&gt;</ins>.</p><p class="diff-line diff-line--equal">Same &amp; old</p>'
    assert got[1] == '<p class="diff-line diff-line--insert"><ins>new</ins></p>' and got[2] == ""


def test_similar_sections_are_all_found():
    rnd = random.Random(7)
    words = "a b c d e f g h".split()
    texts = lambda n: {i: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 8))) for i in range(n)}
    for _ in range(60):
        x, y = texts(7), texts(6)
        want = {(j, i) for j in y for i in x if diff.similarity(y[j], x[i]) >= diff.SIMILAR}
        assert {(j, i) for j, i, _ in diff.similar_sections(x, y)} == want


def section(identity, num, text, kind="new"):
    return {"identity": identity, "num": num, "kind": kind, "text": text, "text_hash": text}


def test_section_alignment():
    before = [section("a", 1, "one two three"), section("b", 2, "four five six"), section("c", 3, "seven eight nine")]
    after = [section("b", 1, "four five six"), section("d", 2, "seven eight nine ten"), section("e", 3, "new words only")]
    got = [(d["status"], d["identity"]) for d in diff.diff_sections(before, after)]
    assert got == [("removed", "a"), ("renumbered", "b"), ("changed", "d"), ("added", "e")]
    assert all(d["status"] == "equal" for d in diff.diff_sections(before, before))


@pytest.mark.parametrize("expr,values,expected", [
    ("1 + 2 * 3", {}, 7.0), ("(1 + 2) * 3", {}, 9.0), ("a + b", {"a": 1.0}, 1.0), ("a + b", {}, None), ("a * b", {"a": 2.0}, None), ("1 / 0", {}, None), ("-a", {"a": 2.0}, -2.0), ("a > b", {"a": 1.0}, False), ("2 >= 2", {}, True),
    ("sum(r.*.fy1)", {"r.0.fy1": 1.0, "r.1.fy1": "$2"}, 3.0), ("avg(r.*.fy1)", {"r.0.fy1": 4.0, "r.1.fy1": None}, 2.0), ("r.bien1", {"r.fy1": 1.0, "r.fy2": 2.0}, 3.0), ("fte.total.bien1", {"fteClass.0.fy1": 1.0, "fteClass.1.fy2": 2.0}, 1.5),
    ("direction(a)", {"a": -1.0}, "decreases"), ("millions(a)", {"a": 1250000.0}, "$1.3 million"), ("thousands(1234567)", {}, "$1,235,000"), ("nonempty(a)", {"a": " "}, False), ("not(a)", {}, True), ("concat('n', 2)", {}, "n2"), ("r[0].x", {"r.0.x": 5.0}, 5.0),
])
def test_formulas(expr, values, expected):
    assert formula.evaluate(expr, values) == expected


def test_compiled_formulas_agree(spark):
    exprs = ["a.fy1 + a.fy2", "a.fy1 - b", "a.fy1 * b", "a.fy1 / b", "a.bien1", "sum(a.fy1, b)", "max(a.fy1, b)", "-b", "avg(a.fy1, b)"]
    rows = [{"a.fy1": 3.0, "a.fy2": 2.0, "b": 4.0}, {"a.fy1": 3.0}, {"b": 0.0, "a.fy1": 1.0}, {}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v map<string,double>")
    got = df.select("i", *[formula.compile_column(e, F.col("v")).alias(f"e{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()
    assert [[r[f"e{k}"] for k in range(len(exprs))] for r in got] == [[formula.evaluate(e, v) for e in exprs] for v in rows]


def test_recompute_lets_later_cells_see_earlier_ones():
    out, _ = formula.recompute([{"expr": "b + 1"}, {"expr": "a * 2", "slot": "b"}], {"a": 3.0})
    assert out == [7.0, 6.0]


def test_workflow_matrix():
    accepted = {(s, e) for s, e, *_ in workflow.RULES}
    actors = {"d": ["drafter"], "dr": ["drafter", "reviewer"], "r": ["reviewer"], "v": ["viewer"], "a": ["admin"]}
    for state, event, (actor, roles) in itertools.product(workflow.STATES, workflow.EVENTS, actors.items()):
        to, reason = workflow.decide(state, event, actor, roles, "d", "m")
        allowed = actor == "d" if event == "SUBMIT" else "reviewer" in roles
        assert (reason is None) == ((state, event) in accepted and allowed) and (to is not None) == (reason is None)
        assert (event in workflow.available(state, actor, roles, "d")) == (reason is None)
    assert workflow.decide("in_review", "APPROVE", "d", ["reviewer"], "d", "m")[1] == "not_allowed"
    assert workflow.decide("in_review", "REQUEST_CHANGES", "r", ["reviewer"], "d", "  ")[1] == "message_required"
    assert workflow.decide("draft", "NONE", "d", [], "d", None)[1] == "unknown_event"


def test_fold_of_a_log_is_the_fold_of_its_parts():
    rnd = random.Random(5)
    log = [{"arrival": i, "event": rnd.choice(workflow.EVENTS), "actor_id": a, "actor_roles": [{"d": "drafter", "r": "reviewer"}[a]], "drafter_id": "d", "message": rnd.choice(["m", ""]), "expected_version": rnd.choice([None, None, 0]), "head_version": i} for i, a in enumerate(rnd.choices("dr", k=200))]
    whole, state = workflow.fold(log)
    for cut in (0, 1, 57, 200):
        first, middle = workflow.fold(log[:cut])
        rest, end = workflow.fold(log[cut:], middle)
        assert first + rest == whole and end == state


def test_publish_uses_the_approved_version():
    r = {"actor_id": "r", "actor_roles": ["reviewer"], "drafter_id": "d", "message": "m"}
    log = [{**r, "arrival": 1, "event": "SUBMIT", "actor_id": "d"}, {**r, "arrival": 2, "event": "APPROVE", "head_version": 4}, {**r, "arrival": 3, "event": "PUBLISH", "head_version": 9}]
    assert workflow.fold(log)[1]["published_version"] == 4


def test_requeue_and_soft_delete(spark):
    old = spark.createDataFrame([(1, "h1", "done", "2024-01-01"), (2, "h2", "done", None)], "id int, h string, status string, d string")
    new = spark.createDataFrame([(1, "h1", None), (2, "hx", "2024-02-02"), (3, "h3", None)], "id int, h string, d string")
    got = {r["id"]: (r["h"], r["status"], r["d"]) for r in relational.requeue(old, new, "id", "h", "status", ["d"]).collect()}
    assert got == {1: ("h1", "done", "2024-01-01"), 2: ("hx", "pending", "2024-02-02"), 3: ("h3", "pending", None)}


def test_pages_join_to_the_whole_order(spark):
    df = spark.range(23).withColumn("at", (F.col("id") % 4).cast("int"))
    pages, cursor = [], None
    while True:
        rows = relational.keyset_page(df, "at", "id", 5, cursor).collect()
        pages += rows[:5]
        if len(rows) <= 5:
            break
        cursor = (rows[4]["at"], rows[4]["id"])
    assert [(r["at"], r["id"]) for r in pages] == sorted(((i % 4, i) for i in range(23)), reverse=True)


@pytest.mark.parametrize("value,kind,shown", [(1234567.0, "money", "1,234,567"), (-2.5, "money", "(3)"), (0.845, "fte", "0.8"), (-0.8, "fte", "(0.8)"), (1.005, "pct", "1.0%"), (-1.25, "pct", "-1.3%"), (-5.0, "money-thousands", "($5)"), (-5.0, "int", "-5"), (1234.5, None, "1,234.5"), (-7.0, "text", "(7)"), (None, "money", "")])
def test_format_number(value, kind, shown):
    assert format_number(value, kind) == shown


def test_no_similar_pair_is_lost(spark):
    rnd = random.Random(5)
    some = lambda n: rnd.sample([f"w{i}" for i in range(30)], n)
    left = [(i, some(rnd.randint(1, 12))) for i in range(40)] + [(7, ["same", "words"]), (7, []), (None, ["same"]), (99, ["nowhere"])]
    right = [(f"i{i}", some(rnd.randint(1, 12))) for i in range(5)] + [("x", ["same", "words"]), ("y", ["same", "words"]), ("z", []), (None, ["same"])]
    got = relational.similar_pairs(spark.createDataFrame(left, "doc_id long, a array<string>"), spark.createDataFrame(right, "item_id string, b array<string>"), 0.1)
    force = [(i, j, len(set(a) & set(b)) / len(set(a) | set(b))) for i, a in left for j, b in right if i is not None and j is not None and set(a) & set(b)]
    assert sorted(map(tuple, got.collect())) == sorted(p for p in force if p[2] >= 0.1)
    assert (7, "x", 1.0) in force and got.limit(0).columns == ["doc_id", "item_id", "score"]
    assert relational.similar_pairs(spark.createDataFrame(left, "doc_id long, a array<string>"), spark.createDataFrame([], "item_id string, b array<string>"), 0.1).collect() == []


def test_permissions(spark):
    from pyspark.sql import functions as F

    people = {"d": ["drafter"], "e": ["drafter"], "r": ["reviewer"], "a": ["admin"], "v": ["viewer"], "dr": ["drafter", "reviewer"]}
    states = ["draft", "in_review", "approved", "published"]
    df = spark.createDataFrame([(u, r, s, "dr" if u == "dr" else "d", "r", ["e"] if s == "approved" else None) for u, r in people.items() for s in states], "u string, roles array<string>, state string, drafter string, reviewer string, parts array<string>")
    allow = {(a, r["u"], r["state"]) for a in workflow.ACTIONS for r in df.where(workflow.can(a, F.col("roles"), F.col("u"), F.col("state"), F.col("drafter"), F.col("reviewer"), F.col("parts"))).collect()}
    who = lambda action, state: {u for a, u, s in allow if (a, s) == (action, state)}
    assert who("note.read", "published") == set(people) and who("note.read", "draft") == {"d", "r", "a", "dr"} and "e" in who("note.read", "approved")
    assert who("note.comment", "published") == set(people) - {"v"} and who("note.edit", "draft") == who("note.submit", "draft") == {"d", "dr"}
    assert who("note.review", "in_review") == {"r"} and who("note.publish", "approved") == {"r"} and not who("note.review", "draft")
    assert who("search.reindex", "draft") == {"a"} and who("note.create", "draft") == {"d", "r", "a", "dr"} and who("bill.read", "draft") == set(people)


def test_shown_amounts(spark):
    from pyspark.sql import functions as F

    from docketry.functions import text

    values = [0.0, -2.5, 1250000.0, 1234567.0, -999.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for kind in ("money", "money-thousands", "int", "fte", "pct", None):
        assert [r[0] for r in df.select(text.format_column(F.col("v"), kind)).collect()] == [text.format_number(v, kind) for v in values]
    assert [tuple(r) for r in df.select(text.millions(F.col("v")), text.thousands(F.col("v"))).collect()][2:4] == [("$1.3 million", "$1,250,000"), ("$1.2 million", "$1,235,000")]


def test_a_failed_consumer_is_recorded(spark, tmp_path):
    from docketry.streaming import relay

    batch = spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, event_type string")

    def broken(_):
        raise RuntimeError("no index")

    log = f"file://{tmp_path}/log"
    assert relay.deliver(batch, "index", log, broken) == "no index"
    (row,) = relay.failures(spark, log).collect()
    assert (row["consumer"], row["error"]) == ("index", "RuntimeError: no index") and relay.claims(spark, log).where(f"batch = '{row['batch']}'").count() == 2
    seen = []
    relay.deliver(batch, "index", log, lambda df: seen.extend(df.collect()))
    assert seen == [] and relay.failures(spark, log).count() == 1


def test_events_come_in_order_and_claims_are_compacted(spark, tmp_path):
    from docketry.streaming import relay

    log, seen = f"file://{tmp_path}/log", []
    rows = [(i * 30_000, "a" if i % 5 else "b") for i in range(23)] + [(60_000, "a"), (None, "a")]
    batch = spark.createDataFrame(rows, "event_id long, event_type string").repartition(3)

    def handler(df):
        got = sorted(r["event_id"] for r in df.collect())
        seen.append(got)
        if 270_000 in got:
            raise RuntimeError("down")

    assert relay.deliver(batch, "c", log, handler, ["a"], most=5) == "down"
    want = sorted(i for i, kind in rows if i is not None and kind == "a")
    assert [x for part in seen for x in part] == want and max(map(len, seen)) <= 6 and relay.failures(spark, log).count() == 1
    assert all(a[-1] < b[0] for a, b in itertools.pairwise(seen))
    plan = relay.claimed(spark, log, "c", 0, 99_999)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = lambda: len(list((tmp_path / "log").rglob("*.parquet")))
    before, n = {r["event_id"] for r in relay.claims(spark, log).collect()}, files()
    relay.compact(spark, log, 500_000, f"file://{tmp_path}/scratch")
    assert {r["event_id"] for r in relay.claims(spark, log).collect()} == before and files() < n
    seen.clear()
    relay.deliver(batch, "c", log, handler, ["a"], most=5)
    assert [x for part in seen for x in part] == []


@pytest.mark.parametrize("text,kind", [("This act is necessary for the immediate preservation of the public peace and takes effect immediately.", "emergency"), ("If any provision is held invalid, the remainder is not affected.", "severability"), ("Section 3 of this act expires July 1, 2030.", "expiration"), ("takes effect only if SB 1 is enacted", "contingent"), ("The sum of $5 is", "appropriation"), ("The legislature finds that", "intent"), ("This act takes effect July 1.", "new")])
def test_kinds_of_sections(spark, text, kind):
    from pyspark.sql import functions as F

    from docketry.functions import clauses

    assert clauses.section_kind(text) == kind == spark.createDataFrame([(text,)], "t string").select(clauses.section_kind_column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,filters,rest,searched", [("HB 1500", {}, "", False), ("SB 5900 salmon", {"bill_key": "WA:2025-26:SB5900"}, "SALMON", True), ("RCW 82.04.050", {"rcw_cites": "82.04.050"}, "", True), ("chapter 82.04 RCW", {"rcw_chapters": "82.04"}, "", True), ("2019 c 7", {}, "Chapter 7, 2019 Laws", True), ("salmon", {}, "salmon", True)])
def test_what_a_search_asks_for(text, filters, rest, searched):
    from docketry.operators import search

    got = search.asked(text, "2025-26")
    assert (got["filters"], got["text"], got["search"]) == (filters, rest, searched)


def test_striking_amendments_are_versions(spark):
    sections = spark.createDataFrame([("b", "I", "one")], "bill_key string, version_code string, text string")
    amendments = spark.createDataFrame([("b", "S4812.1", True, "two"), ("b", "S4813.1", False, "three")], "bill_key string, drafter_number string, striking boolean, text string")
    assert {tuple(r) for r in diff.with_striking(sections, amendments).collect()} == {("b", "I", "one"), ("b", "AMD:S4812.1", "two")}


def test_permission_fields_are_not_for_callers():
    assert relational.without_forbidden({"q": 1}) == {"q": 1}
    with pytest.raises(ValueError, match="visibility"):
        relational.without_forbidden({"q": 1, "visibility": "public"})


def test_counts_of_sections_agree_with_their_lines_and_align_no_lines_of_one_side():
    """Counts are those of `diff_sections`; sections that are new, gone or equal, and lines that begin alike, aren't aligned."""
    rnd = random.Random(8)
    text = lambda: "\n".join(" ".join(rnd.choice(["tax", "the ", "of", "plain", "x"]) for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(0, 4)))
    side = lambda: [{"identity": f"i{rnd.randint(0, 5)}", "num": rnd.choice([None, 1, 2]), "kind": rnd.choice("ab"), "text": (t := text()), "text_hash": rnd.choice([t, None, "h"])} for _ in range(rnd.randint(0, 6))]
    names = ("identity", "from_num", "to_num", "status", "changed", "inserted", "deleted")
    for k in range(2000):
        before, after = side(), side()
        if k % 2:
            after = [s | {"text": s["text"] + rnd.choice(["", " more"]), "text_hash": str(rnd.random())} for s in before] + after[:1]
        assert list(diff.count_sections(before, after)) == [tuple(d[n] for n in names) for d in diff.diff_sections(before, after)]
    with mock.patch.object(diff, "myers", side_effect=AssertionError("aligned")):
        new = {"identity": "a", "num": 1, "kind": "k", "text": "one\ntwo", "text_hash": "h"}
        assert list(diff.count_sections([], [new])) == [("a", None, 1, "added", 0, 2, 0)]
        assert list(diff.count_sections([new], [new | {"num": 2}])) == [("a", 1, 2, "renumbered", 0, 0, 0)]
        assert diff.is_paired("the tax is five", "the tax is six") and diff.count_lines([], ["x"]) == (0, 1, 0)
    with mock.patch.object(diff, "_middle", side_effect=AssertionError("searched")):
        assert diff.count_lines(["one", "two words"], ["zero", "one", "two words more"]) == (1, 1, 0)


def test_a_wildcard_is_made_a_pattern_once_for_all_values():
    values = {f"row.{i}.fy1": float(i) for i in range(300)}
    formula._shape.cache_clear()
    with mock.patch.object(formula.re, "escape", wraps=formula.re.escape) as made:
        assert formula.evaluate("sum(row.*.fy1)", values) == sum(range(300)) and formula.evaluate("sum(row.*.bien1)", values) == sum(range(300))
    assert made.call_count <= 3
