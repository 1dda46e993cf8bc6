import json

import pytest
from pyspark.sql import functions as F

from docketry.functions.stem import stem
from docketry.operators import search
from docketry.sources import bills, documents

BILL = """<Bill type="bill" xmlns="http://x/"><BillHeading><ShortBillId>HB 1500</ShortBillId><LongBillId>HOUSE BILL 1500</LongBillId><BillHistory><ReadDate>READ FIRST TIME 02/18/25.</ReadDate></BillHistory></BillHeading>
<BillBody><BillTitle>AN ACT Relating to fish; amending RCW 77.04.010.</BillTitle>
<BillSection type="amendatory" action="amend"><BillSectionHeader><BillSectionNumber><Value>1</Value></BillSectionNumber><SectionCite><TextRun>RCW </TextRun><TitleNumber>77</TitleNumber>.<ChapterNumber>04</ChapterNumber>.<SectionNumber>010</SectionNumber></SectionCite> is amended<Caption>Fish.</Caption></BillSectionHeader>
<P>(1) Fish are <TextRun amendingStyle="strike">bad</TextRun> <TextRun amendingStyle="add">very good</TextRun>.</P><P>(a)(i) First.</P><P>(ii) Second.</P><P>(b) Third.</P><P>(2) Last.</P></BillSection>
<BillSection type="new" action="effdate"><BillSectionHeader><BillSectionNumber><Value>2</Value></BillSectionNumber></BillSectionHeader><P>This act takes effect July 1, 2026.</P></BillSection></BillBody></Bill>"""


def test_bill_xml():
    d = documents.parse_bill_xml(BILL)
    one, two = d["sections"]
    assert (d["short_id"], d["read_first"], one["identity"], two["identity"], one["caption"]) == ("HB 1500", "2025-02-18", "rcw:77.04.010", "kind:effective-date", "Fish")
    assert [(b["label"], b["depth"]) for b in one["blocks"]] == [("(1)", 1), ("(a)", 2), ("(i)", 3), ("(ii)", 3), ("(b)", 2), ("(2)", 1)]
    assert one["blocks"][0]["text"] == "Fish are very good." and "((bad))" in one["blocks"][0]["raw"] and (one["ins_words"], one["del_words"]) == (2, 1)
    assert one["blocks"][3]["block_id"] == "sec-1.1.a.ii" and one["blocks"][3]["parent_id"] == "sec-1.1.a"


def test_bill_htm_and_amendment():
    htm = '<!-- field: Sponsors -->A &amp; B<!-- field: --><div><!-- field: BeginningSection -->Sec. 1.  RCW 77.04.010 is amended to read</div><div>(1) Fish are <span style="text-decoration:line-through;">bad</span> <span style="text-decoration:underline;">good</span>.</div>'
    d = documents.parse_bill_htm(htm)
    assert d["sponsors"] == "A & B" and d["sections"][0]["identity"] == "rcw:77.04.010" and d["sections"][0]["blocks"][-1]["text"] == "Fish are good."
    amd = documents.parse_amendment_xml('<Amendment><AmendTitle><AmendType>AMS</AmendType><DraftNumber>S1.1</DraftNumber></AmendTitle><AmendBody><AmendSection><FloorAction>ADOPTED 03/04/2025</FloorAction><AmendItem><P>On page 2, line 5, strike "fish" and insert "bird"</P></AmendItem></AmendSection></AmendBody></Amendment>')
    assert (amd["style"], amd["adopted"], amd["disposition_date"], amd["instructions"]) == ("page_line", True, "2025-03-04", [{"op": "strike_insert", "page": 2, "line": 5, "quoted": ["fish", "bird"]}])


LAW = """<CertifiedBill xmlns="http://x/"><EnrollingCertificate><ChapterLaw year="2026">246</ChapterLaw><SessionLawCaption>FISH</SessionLawCaption><EffectiveDate><P>June 11, 2026</P></EffectiveDate><Table><TR><TDEnroll><PassedBy chamber="s"><PassedDate>March 10</PassedDate><Yeas>43</Yeas><Nays>6</Nays></PassedBy><PassedBy chamber="h"><PassedDate>March 6</PassedDate><Yeas>70</Yeas></PassedBy><PassedBy chamber="h"/></TDEnroll><TDEnroll><ApprovedDate>March 30</ApprovedDate></TDEnroll></TR></Table></EnrollingCertificate>
<Bill><BillBody><BillSection type="amendatory" action="amend"><BillSectionHeader><BillSectionNumber><Value>1</Value></BillSectionNumber></BillSectionHeader>
<P><TextRun amendingStyle="strike">(2)</TextRun><TextRun amendingStyle="add">(3)</TextRun> Moved.</P><P><TextRun amendingStyle="add">(a) New.</TextRun></P><P><TextRun amendingStyle="strike">(b) Gone.</TextRun></P>
<Table><THead><TR><TD colspan="2" textAlign="center"><P>Head</P><P>line</P></TD><TD rowspan="2">Tall</TD></TR></THead><TR><TD>one</TD><TD><P><TextRun amendingStyle="strike">5</TextRun> <TextRun amendingStyle="add">6</TextRun></P></TD></TR><TR><TD rowspan="x">a</TD><TD>b</TD><TD>c</TD></TR></Table><P>After.</P></BillSection></BillBody></Bill><SLHistory><P>Passed.</P><P> </P></SLHistory></CertifiedBill>"""


def test_tables_renumbering_and_certificates(spark):
    d = documents.parse_bill_xml(LAW)
    (section,) = d["sections"]
    assert [(b["label"], b["label_mark"], b["renumbered"], b["text"]) for b in section["blocks"][:3]] == [("(3)", "ins", "(2)", "Moved."), ("(a)", "ins", None, "New."), ("(b)", "del", None, "")]
    assert [b["text"] for b in section["blocks"][3:]] == ["Head line | Tall", "one | 6", "a | b | c", "After."] and section["blocks"][4]["struck"] == "((5))"
    cells = {(c["row"], c["column"]): c for c in section["tables"][0]}
    assert sorted(cells) == [(0, 0), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert (cells[0, 0]["column_span"], cells[0, 0]["align"], cells[0, 0]["header"], cells[0, 2]["row_span"], cells[2, 0]["row_span"], cells[1, 0]["header"]) == (2, "center", True, 2, 1, False)
    c = d["certificate"]
    assert (c["chapter"], c["year"], c["caption"], c["effective_date"], c["approved_date"], c["partial_veto"], c["history"]) == (246, 2026, "FISH", "June 11, 2026", "March 30", False, ["Passed."])
    assert c["passed"] == [{"chamber": "S", "date": "March 10", "yeas": 43, "nays": 6}, {"chamber": "H", "date": "March 6", "yeas": 70, "nays": None}]
    assert documents.parse_bill_xml(BILL)["certificate"] is None
    files = spark.createDataFrame([("a", "xml", LAW), ("b", "xml", BILL)], "key string, format string, content string")
    assert documents.parse_all(files, "cells").count() == 7 and {(r["key"], r["chamber"], r["yeas"]) for r in documents.parse_all(files, "certificates").collect()} == {("a", "S", 43), ("a", "H", 70)}


def test_parse_all_reports_what_does_not_parse(spark):
    files = spark.createDataFrame([("a", "xml", BILL), ("b", "xml", "<Bill><P></Bill>"), ("c", "htm", "")], "key string, format string, content string")
    rows = documents.parse_all(files, "sections").collect()
    assert {(r["key"], r["num"]) for r in rows if r["error"] is None} == {("a", 1), ("a", 2)} and [r["key"] for r in rows if r["error"]] == ["b"]
    assert documents.parse_all(files, "blocks").where("key = 'a'").count() == 7


def record(number, change, status=1, calendar=()):
    return {"bill": {"bill_id": 1, "change_hash": change, "status": status, "status_date": "0000-00-00", "session": {"year_start": 2025, "year_end": 2026}, "bill_number": number, "title": "t", "history": [{"date": "2025-01-02", "action": "First"}, {"date": "2025-05-02", "action": "Chapter 7, 2025 Laws."}], "sasts": [{"type": "Crossfiled", "sast_bill_number": "SB5900"}],
                     "texts": [{"doc_id": 1, "date": "2025-01-02", "state_link": f"http://x/{number[2:]}.pdf", "text_hash": "a"}, {"doc_id": 2, "date": "2025-01-03", "state_link": f"http://x/{number[2:]}-S.E.pdf", "text_hash": "b"}, {"doc_id": 3, "date": "2025-01-03", "state_link": f"http://x/{number[2:]}-S.E.pdf", "text_hash": "c"}], "amendments": [], "supplements": [], "calendar": list(calendar), "sponsors": []}}


def test_reload(spark, tmp_path):
    ahead = {"event_hash": "e1", "date": "2026-02-01", "time": "08:00", "description": "Public Hearing", "location": "HR A"}
    past = {"event_hash": "e0", "date": "2025-02-01", "time": "bad", "description": "Exec", "location": "HR B"}
    first, second = tmp_path / "one", tmp_path / "two"
    for folder, bill in ((first, record("HB1500", "h1", 1, [ahead, past])), (second, record("HB1500", "h2", 2))):
        folder.mkdir()
        (folder / "HB1500.json").write_text(json.dumps(bill))
    (second / "HB1501.json").write_text(json.dumps(record("HB1501", "x")))
    as_of = F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00"))
    none = {k: v.limit(0) for k, v in bills.tables(bills.read_dataset(spark, str(first))).items()}
    one, events = bills.reload(bills.read_dataset(spark, str(first)), none, as_of)
    assert sorted(r["type"] for r in events.collect()) == ["bill.created", "bill.version_added", "bill.version_added", "hearing.scheduled", "hearing.scheduled"]
    b = one["bills"].first()
    assert (b["bill_key"], b["status_date"], b["companion"], b["chapter_law"], str(b["last_action_date"])) == ("WA:2025-26:HB1500", None, "SB5900", "Chapter 7, 2025 Laws", "2025-05-02")
    assert {(r["version_code"], r["doc_id"], r["seq"]) for r in one["versions"].collect()} == {("I", 1, 0), ("S.E", 2, 11)}
    assert {str(r["at"]) for r in one["hearings"].collect()} == {"2026-02-01 16:00:00", "2025-02-01 08:00:00"}
    again, events = bills.reload(bills.read_dataset(spark, str(first)), one, as_of)
    assert events.count() == 0 and again["hearings"].count() == 2
    two, events = bills.reload(bills.read_dataset(spark, str(second)), one, as_of)
    assert {(r["type"], r["bill_key"][-4:]) for r in events.collect()} == {("bill.status_changed", "1500"), ("hearing.cancelled", "1500"), ("bill.created", "1501"), ("bill.version_added", "1501")}
    assert {r["id"][-2:]: r["cancelled"] for r in two["hearings"].collect()} == {"e0": False, "e1": True}


@pytest.mark.parametrize("word,expected", [("taxation", "taxat"), ("communities", "communiti"), ("running", "run"), ("agreed", "agre"), ("generalization", "general"), ("ties", "tie"), ("happy", "happi"), ("hoping", "hope")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_search(spark):
    rows = [("a", "Fish tax", "The state tax on fishing.", "public", [], [], "g1", "en"), ("b", "Roads", "A state road and a tax levy.", "public", [], [], "g1", "en"), ("c", "Fish", "Secret fish.", "restricted", ["reviewer"], [], "g2", "fr"), ("d", "Parks", "No match here", "public", [], [], "g3", "en")]
    docs = spark.createDataFrame(rows, "id string, title string, body string, visibility string, allowed_roles array<string>, allowed_users array<string>, grp string, lang string")
    docs = search.analyse(docs, {"title": "A", "body": "C"})
    found = lambda q, roles=("drafter",): [r["id"] for r in search.search(docs, q, F.lit(True), list(roles), "u", F.col("grp"), "id")["page"].collect()]
    assert found("fish") == ["a"] and set(found("fish", ("reviewer",))) == {"a", "c"} and found('"state tax"') == ["a"] and found("tax -fish") == ["b"]
    got = search.search(docs, "fish or tax", F.lit(True), ["drafter"], "u", F.col("grp"), "id", facet_columns={"lang": "lang"})
    assert got["total"].first()[0] == 1 and [tuple(r) for r in got["facets"].collect()] == [("lang", "en", 2)] and [r["id"] for r in got["inner_hits"].collect()] == ["b"]
    assert [r["headline"] for r in search.with_headline(docs.where("id = 'a'"), ("term", "fish"), "body").collect()] == ["<mark>fishing.</mark>"]
    forms = docs.withColumn("forms", F.array(F.concat(F.lit("HB "), "id")))
    assert [r["id"] for r in search.suggest(forms, "hb a", "title", "forms").collect()] == ["a"] and [r["id"] for r in search.suggest(forms, "road", "title", "forms").collect()] == ["b"]


def test_analysis_for_one_query(spark):
    """The terms of a query alone stand where the whole analysis has them, in all fields; a stem keeps the first letter."""
    rows = [(1, "Roads, roads and the dying road", "Tied skies; taxes on a road"), (2, None, "Lying by the roads"), (3, "", None)]
    docs = spark.createDataFrame(rows, "id int, title string, body string")
    tree = search.parse_query('road -"taxes road" OR lying')
    asked = set(search.all_terms(tree))
    assert asked == {"road", "tax", "lie"}
    plain = lambda df: {r["id"]: [(t["term"], t["at"], t["weight"]) for t in r["terms"]] for r in df.collect()}
    whole, own = plain(search.analyse(docs, {"title": "A", "body": "C"})), plain(search.analyse(docs, {"title": "A", "body": "C"}, only=asked))
    assert own == {k: [t for t in ts if t[0] in asked] for k, ts in whole.items()}
    assert own == {1: [("road", [1, 2, 6], "A"), ("tax", [10], "C"), ("road", [13], "C")], 2: [("lie", [2], "C"), ("road", [5], "C")], 3: []}
    assert all(stem(w)[0] == w[0] for w in ("dying", "tied", "skies", "yes", "ying", "x's", "ies", "ed", "sses", "ational", "ement", "ion"))


def test_only_what_is_asked_for_is_made():
    """Cells, blocks and the certificate are the same alone as from the whole document, and nothing beside them is made."""
    law = LAW.replace("<Value>1</Value>", "<Value>²</Value>")
    whole = documents.parse_bill_xml(LAW)
    for rows in ("cells", "blocks", "certificates"):
        own = documents.parse_bill_xml(LAW, rows)
        assert list(own) == (["certificate"] if rows == "certificates" else ["sections"])
        assert own.get("certificate", whole["certificate"]) == whole["certificate"]
        for a, b in zip(own.get("sections", []), whole["sections"], strict=False):
            assert set(a) == {"ordinal", "section_id", "tables" if rows == "cells" else "blocks"} and all(a[k] == b[k] for k in a)
        assert len(own.get("sections", whole["sections"])) == len(whole["sections"]) > 0
    assert list(documents.rows_of(documents.parse_bill_xml(law, "certificates"), "certificates")) == list(documents.rows_of(whole, "certificates"))
    assert documents.clean(" a ﻿ b ") == "a b"


def test_reload_holds_keys_alone(spark, tmp_path):
    """What is written on the way of a reload are keys of changed bills, whatever else a bill has."""
    (tmp_path / "a.json").write_text(json.dumps(record("HB1500", "h1", 1)))
    rows = bills.read_dataset(spark, str(tmp_path))
    seen = []
    _, events = bills.reload(rows, {k: v.limit(0) for k, v in bills.tables(rows).items()}, F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")), lambda df: seen.append(df.columns) or df)
    assert seen == [["_key"]] and "bill.created" in events.columns + [r["type"] for r in events.where("type = 'bill.created'").collect()]
