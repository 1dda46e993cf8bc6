import json

import pytest

from docketry.operators import estimate, templates
from docketry.plans import legislative

CELL = lambda col, value, **a: {"type": "noteCell", "attrs": {"col": col, "value": value, **a}, "content": [{"type": "text", "text": "" if value is None else str(value)}]}
ROW = lambda kind, key, *cells: {"type": "noteRow", "attrs": {"rowKind": kind, "key": key}, "content": list(cells)}
DOC = {"type": "doc", "content": [
    {"type": "paragraph", "content": [{"type": "text", "text": "Hello "}, {"type": "slot", "attrs": {"slot": "a[0]", "required": True, "hint": "name"}, "content": [{"type": "text", "text": "name"}]}]},
    {"type": "noteTable", "attrs": {"role": estimate.ACCOUNTS}, "content": [ROW("account", "001", CELL("fy1", 10.0), CELL("fy2", None)), ROW("account", "002", CELL("fy1", 5.0), CELL("fy2", 1.0)), ROW("total", "t", CELL("fy1", 15.2), CELL("fy2", 2.0))]},
    {"type": "noteTable", "attrs": {"role": estimate.OBJECTS}, "content": [ROW("object", "A", CELL("fy1", 15.0), CELL("fy2", 3.0))]},
]}


def test_facts_and_rules(spark):
    docs = spark.createDataFrame([("n", json.dumps(DOC)), ("m", None)], "id string, doc string")
    facts = estimate.fact_table(docs, "id", "doc").cache()
    assert facts.count() == 8
    assert [(r["part"], r["fy"], r["stated"], r["summed"]) for r in estimate.total_errors(facts).collect()] == [(estimate.ACCOUNTS, 2, 2.0, 1.0)]
    assert [(r["fy"], r["stated"], r["summed"]) for r in estimate.object_errors(facts).collect()] == [(2, 1.0, 3.0)]
    assert estimate.staff_errors(facts).count() == 0
    assert {(r["row_key"], r["value"]) for r in estimate.biennia(facts).where(f"part = '{estimate.ACCOUNTS}'").collect()} == {("001", 10.0), ("002", 6.0), ("t", 17.2)}
    nodes = estimate.flatten(docs, "id", "doc")
    assert estimate.document_text(nodes).first()["text"].startswith("Hello name10.0") and nodes.where("depth = 0").count() == 1


def test_slots():
    assert estimate.slots(DOC)[0] == {"slot": "a[0]", "required": True, "filled": False, "computed": None}
    assert estimate.slot_values({"type": "checkbox", "attrs": {"slot": "x[1]", "checked": True}}) == {"x.1": True}


def test_templates():
    context = {"bill": {"id": "HB 1500", "parts": [{"n": "a<b"}, {"n": "c"}]}, **templates.session_labels(2025), "show": True, "hide": ""}
    got = templates.load('<p data-condition="show">{{bill.id}} {{fy.1}} {{bien.3}} {{fy.2.year}} {{fy.10.yy}} {{nope.x}}</p><p data-condition="hide">gone</p><li data-repeat="bill.parts">{{item.n}}</li><span data-slot="a" data-required>?</span>', context)
    assert got["html"] == '<p>HB 1500 FY 2026 2029-31 2027 35 {{nope.x}}</p><li>a&lt;b</li><li>c</li><span data-slot="a" data-required>?</span>'
    assert got["unknown"] == ["nope.x"] and got["slots"][0]["required"] and templates.resolve_token("bill.parts[1].n", context) == "c"


def test_exports():
    assert templates.to_html({"type": "paragraph", "content": [{"type": "text", "text": "a&b", "marks": [{"type": "bold"}]}]}) == "<p><strong>a&amp;b</strong></p>"
    assert '<Field path="a[0]" type="text" value="">name</Field>' in templates.export_xml(DOC, {"bill": "HB 1500"})


def test_session_labels():
    odd, even = templates.session_labels(2025), templates.session_labels(2026)
    assert odd == even and odd["fy"][0] == {"label": "FY 2026", "year": 2026, "yy": "26"} and odd["bien"] == ["2025-27", "2027-29", "2029-31"] and odd["cy"][5] == "CY 2031" and odd["biennium"] == "2025-26"


def test_rules_of_a_note(spark):
    staff = {"type": "noteTable", "attrs": {"role": estimate.CLASSES}, "content": [ROW("class", "a", CELL("fy1", 1.0), CELL("fy2", 2.0)), ROW("class", "b", CELL("fy1", 0.5))]}
    money = {"type": "noteTable", "attrs": {"role": estimate.ACCOUNTS}, "content": [ROW("account", "001", CELL("fy1", 10.0)), ROW("fte", "f", CELL("fy1", 1.6), CELL("fy2", 2.0)), ROW("total", "t", CELL("fy2", 7.0))]}
    objects = {"type": "noteTable", "attrs": {"role": estimate.OBJECTS}, "content": [ROW("object", "A", CELL("fy1", 10.4), CELL("fy3", 4.0))]}
    docs = spark.createDataFrame([("n", json.dumps({"type": "doc", "content": [staff, money, objects]}))], "id string, doc string")
    facts = estimate.fact_table(docs, "id", "doc").cache()
    assert [(r["fy"], r["stated"], r["summed"]) for r in estimate.object_errors(facts).collect()] == [(3, 0.0, 4.0)]
    assert [(r["fy"], r["stated"], r["summed"]) for r in estimate.staff_errors(facts).collect()] == [(1, 1.6, 1.5)]
    assert [(r["fy"], r["stated"], r["summed"]) for r in estimate.total_errors(facts).collect()] == [(2, 7.0, 0.0)]
    assert {(r["row_key"], r["value"]) for r in estimate.biennia(facts).where(f"part = '{estimate.CLASSES}'").collect()} == {("a", 1.5), ("b", 0.25)}


def test_computed_cells(spark):
    cell = lambda rule, value, **a: CELL("bien1", value, computed=rule, **a)
    inputs = ROW("row", "in", CELL("fy1", 10.0, slot="x.fy1"), CELL("fy2", 5.0, slot="x.fy2"))
    rows = [inputs, ROW("row", "ok", cell("sum(x.fy1, x.fy2)", 15.0)), ROW("row", "off", cell("sum(x.fy1, x.fy2)", 16.0)), ROW("row", "blank", cell("x.fy1 * 2", None)), ROW("row", "avg", cell("avg(x.fy1, x.fy2)", 7.4)), ROW("row", "none", cell("nope", 1.0))]
    doc = {"type": "doc", "content": [{"type": "noteTable", "attrs": {"role": "t"}, "content": rows}]}
    got = estimate.computed_errors(spark.createDataFrame([("n", json.dumps(doc))], "id string, doc string"), "id", "doc").collect()
    assert [tuple(r)[1:] for r in got] == [("biennium_sum", "t/off/bien1", 15.0, 16.0), ("computed_mismatch", "t/blank/bien1", 20.0, None), ("fte_biennium_average", "t/avg/bien1", 7.5, 7.4)]


def test_reader_agrees_with_whole_texts(monkeypatch):
    """Rows are taken out of a text only where that changes nothing, and rows that look alike are read once."""
    tight = lambda doc: json.dumps(doc, separators=(",", ":"))
    table = lambda *rows, role="t", **a: {"type": "noteTable", "attrs": {"role": role, **a}, "content": list(rows)}
    doc = lambda *nodes: {"type": "doc", "content": list(nodes)}
    plain = ROW("account", "1", CELL("fy1", 2.0), CELL("fy2", None), CELL("note", 5.0), CELL("fy3", "(1,000)"))
    odd = {"type": "noteRow", "attrs": {"footer": True, "account": 7}, "content": [{"type": "noteCell", "attrs": {"slot": "x.fy12", "value": True}}, {"type": "noteCell", "content": []}]}
    turned = {"attrs": {"key": "k"}, "type": "noteRow", "content": [CELL("fy1", 4.0)]}
    quoted = {"type": "text", "text": '{"type":"noteRow","attrs":{}}, \\ {\"type\":\"noteTable\"'}
    nested = ROW("account", "n", {"type": "noteCell", "attrs": {"col": "fy1"}, "content": [table(plain)]})
    docs = [DOC, doc(table(plain, odd), quoted, table(plain, role=None)), doc({"type": "p", "content": [quoted, table(plain)]}), doc(table(plain, turned, odd)), doc(table(nested)), doc(plain), doc(plain, table(odd)), doc({"type": "p", "content": [nested]})]
    docs += [table(plain), doc(table()), doc(), {"type": "doc"}, doc(table(ROW("row", "h", CELL("fy1", 1.0)) | {"attrs": {"header": True}}, plain)), doc(table(plain, by=odd)), doc(table(plain, {"type": "other", "content": [odd]}))]
    read = estimate.fact_reader()
    for text in [*map(tight, docs), *map(json.dumps, docs)] * 2:
        assert read(text) == estimate.facts(json.loads(text))
    for broken in ('{"type":"doc","content":[1{"type":"noteRow","content":[]}]}', tight(docs[1])[:-1], tight(docs[1]) + "1", '{"type":"doc","content":[{"type":"noteRow",]}'):
        with pytest.raises(json.JSONDecodeError):
            read(broken)
    seen = []
    monkeypatch.setattr(estimate, "row_facts", lambda row, own=estimate.row_facts: seen.append(row) or own(row))
    read = estimate.fact_reader()
    assert len([f for n in range(200) for f in read(tight(doc(table(plain, *[ROW("account", str(k), CELL("fy1", n % 3)) for k in range(4)], odd))))]) == 200 * 8 and len(seen) == 1 + 3 * 4 + 1


def test_biennia_of_documents(spark):
    """Documents summed where they are read have the sums of their facts, and are not dealt out again."""
    rows = [ROW("account", "1", CELL("fy1", 2.0), CELL("fy2", 3.0), CELL("fy3", None), CELL("fy6", 4.5)), ROW("account", "1", CELL("fy1", 8.0), CELL("fy0", 1.0), CELL("fy4", "")), ROW("fte", "f", CELL("fy1", 1.0), CELL("fy2", 2.0))]
    doc = {"type": "doc", "content": [{"type": "noteTable", "attrs": {"role": role}, "content": rows} for role in (estimate.ACCOUNTS, estimate.CLASSES)]}
    docs = spark.createDataFrame([("n", json.dumps(doc)), ("o", json.dumps(DOC, separators=(",", ":"))), ("p", None), ("q", "")], "id string, doc string")
    got = estimate.document_biennia(docs, "id", "doc")
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, estimate.biennia(estimate.fact_table(docs, "id", "doc")).collect()), key=key)
    assert ("n", estimate.ACCOUNTS, "account", "1", 1, 13.0) in map(tuple, got.collect()) and ("n", estimate.CLASSES, "account", "1", 2, None) in map(tuple, got.collect())
    plan = legislative.note_biennia(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
