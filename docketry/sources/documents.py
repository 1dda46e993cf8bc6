"""Bills and amendments from XML and HTM.

Mixed content has an order that Spark's XML reader loses, so a document is parsed in Python, one at a time inside a
grouped batch, into rows: a document header, its sections and their blocks in reading order. A block's depth comes
from its designators, (1)(a)(i)(A), by a stack of the designators that are open.
"""

from __future__ import annotations

import hashlib
import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.clauses import section_kind

# Marks of amended text and how struck text is bracketed.
STRUCK = {"strike": ("((", "))"), "strikemarkleft": ("((", ""), "strikemarkright": ("", "))"), "strikemarknone": ("", "")}
MOST_MARKS = 4
CITES = frozenset(("SectionCite", "ChapterCite", "TitleCite", "UncodCite"))
_SPACE = re.compile(r"\s+")
_MARKER = re.compile(r"\s*\(([0-9]{1,3}|[A-Za-z]{1,5})\)(?=[\s(]|$)")
_ROMAN = re.compile(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")


def clean(text: str) -> str:
    return " ".join(text.replace("\ufeff", " ").split())


def digest(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def tag(node: ET.Element) -> str:
    name = node.tag
    return name.rpartition("}")[2] if "}" in name else name


def tree_of(source: str) -> ET.Element:
    """The root of a document, all names without their namespaces."""
    root = ET.fromstring(source.lstrip("\ufeff").encode())
    for node in root.iter():
        if "}" in node.tag:
            node.tag = node.tag.rpartition("}")[2]
    return root


def below(node: ET.Element, name: str) -> Iterator[ET.Element]:
    """Nodes of a name in a tree of `tree_of`, the node itself too."""
    return node.iter(name)


def text_of(node: ET.Element | None) -> str:
    return clean("".join(node.itertext())) if node is not None else ""


def first(node: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        node = next((x for x in node if tag(x) == name), None) if node is not None else None
    return node


def runs(node: ET.Element) -> list[dict]:
    """Runs (t: text, ins, del or cite, and text) of mixed content, in order; equal neighbours are one run."""
    out: list[dict] = []
    _walk(node, "text", out)
    return out


def _add(out: list[dict], t: str, text: str | None) -> None:
    if not text:
        return
    text = _SPACE.sub(" ", text)
    if out and out[-1]["t"] == t and t != "cite":
        out[-1]["text"] += text
    else:
        out.append({"t": t, "text": text})


def _walk(x: ET.Element, t: str, out: list[dict]) -> None:
    name, style = tag(x), x.get("amendingStyle", "")
    if t == "text" and name in CITES:
        _add(out, "cite", "".join(x.itertext()))
        return
    if name == "Hyphen":
        _add(out, t, "-")
    left, right = STRUCK.get(style, ("", ""))
    t = "ins" if style == "add" else "del" if style in STRUCK else t
    _add(out, t, left)
    _add(out, t, x.text)
    for child in x:
        _walk(child, t, out)
        _add(out, t, child.tail)
    _add(out, t, right)


def effective(rs: list[dict]) -> str:
    """The text as it would read in law, struck text left out."""
    return clean("".join(r["text"] for r in rs if r["t"] != "del"))


def marked(rs: list[dict], mark: str) -> str:
    own = [r["text"] for r in rs if r["t"] == mark]
    return clean(" ".join(own)) if own else ""


def designators(text: str) -> tuple[list[str], str]:
    """Leading designators, four at most, and the text after them."""
    marks: list[str] = []
    while len(marks) < MOST_MARKS and (m := _MARKER.match(text)):
        marks.append(m[1])
        text = text[m.end() :]
    return marks, text.strip()


def opening(rs: list[dict]) -> tuple[list[str], str | None, list[str], str]:
    """(designators, mark, struck ones, text after them) of a paragraph's runs.

    Designators stand in the text that counts, and the mark is that of the run they stand in, if it is inserted. Struck
    designators right before inserted ones are what the paragraph was numbered before; a paragraph that is struck
    altogether keeps its designators, marked so.
    """
    text = effective(rs)
    marks, rest = designators(text)
    solid = [r for r in rs if r["text"].strip()]
    before, i = [], 0
    while i < len(solid) and solid[i]["t"] == "del":
        struck = re.sub(r"^\s*\(\(|\)\)\s*$", "", solid[i]["text"])
        before += designators(struck)[0]
        i += 1
    if not text and before:
        return before, "del", [], ""
    inserted = bool(marks) and i < len(solid) and solid[i]["t"] == "ins" and bool(designators(clean(solid[i]["text"]) + " ")[0])
    return marks, "ins" if inserted else None, before if inserted else [], rest


def is_roman(mark: str) -> bool:
    return bool(mark) and bool(_ROMAN.fullmatch(mark.lower()))


class Outline:
    """The designators that are open, and the depth at which the next one stands: 1, a, i, A, I."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []

    def level(self, mark: str) -> int:
        if mark.isdigit():
            return 1
        base = 2 if mark.islower() else 4
        before = next((m for level, m in reversed(self.open) if level == base), None)
        follows = before is not None and len(mark) == 1 and ord(mark) == ord(before[0]) + 1 and len(before) == 1
        doubled = len(mark) > 1 and len(set(mark)) == 1 and not is_roman(mark)
        inner = next((m for level, m in reversed(self.open) if level == base + 1), None)
        if not is_roman(mark) or doubled or (follows and inner is None) or (before is None and mark.lower() not in ("i",)):
            return base
        return base if follows and inner is not None and mark.lower() not in ("i", "v", "x") else base + 1

    def place(self, mark: str) -> int:
        level = self.level(mark)
        self.open = [x for x in self.open if x[0] < level] + [(level, mark)]
        return len(self.open)


def grid(table: ET.Element) -> list[dict]:
    """Cells of a table as (row, column, row_span, column_span, header, align, runs), row by row.

    A cell stands in the first column that cells above, which span several rows, leave free; its paragraphs are
    joined by blanks. Spans that are no numbers count as 1.
    """
    rows = [(tr, tag(x) == "THead") for x in table for tr in (x if tag(x) == "THead" else [x]) if tag(tr) == "TR"]
    taken: set[tuple[int, int]] = set()
    out = []
    for i, (tr, header) in enumerate(rows):
        column = 0
        for td in (x for x in tr if tag(x) in ("TD", "TDEnroll")):
            while (i, column) in taken:
                column += 1
            down, across = (max(1, int(v)) if (v := td.get(a) or "").isdigit() else 1 for a in ("rowspan", "colspan"))
            taken |= {(i + d, column + a) for d in range(down) for a in range(across)}
            own: list[dict] = []
            for p in [x for x in td if tag(x) == "P"] or [td]:
                own += ([{"t": "text", "text": " "}] if own else []) + runs(p)
            align = td.get("textAlign")
            out.append({"row": i, "column": column, "row_span": down, "column_span": across, "header": header, "align": align if align in ("center", "right") else None, "runs": own})
            column += across
    return out


def table_lines(cells: list[dict]) -> list[dict]:
    """A line for each row of a table: its cells' texts, parted by bars."""
    out = []
    rows: dict[int, list[list[dict]]] = {}
    for c in cells:
        rows.setdefault(c["row"], []).append(c["runs"])
    for _, own in sorted(rows.items()):
        join = lambda of: " | ".join(map(of, own)).strip()
        out.append({"text": join(effective), "raw": join(lambda rs: clean("".join(r["text"] for r in rs))), "inserted": clean(" ".join(marked(rs, "ins") for rs in own)), "struck": clean(" ".join(marked(rs, "del") for rs in own))})
    return out


def parts_of(section: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs and whole tables of a section in reading order; what a table holds isn't given again, nor are histories and notes' headers."""
    for x in section:
        if tag(x) in ("P", "Table"):
            yield x
        elif tag(x) != "BillSectionHeader":
            yield from parts_of(x)


def certificate(root: ET.Element) -> dict | None:
    """What a passed bill's certificate says: chapter, year, caption, effective date, votes by chamber, dates, governor, partial veto and its history."""
    cert, history = next(below(root, "EnrollingCertificate"), None), next(below(root, "SLHistory"), None)
    if cert is None and history is None:
        return None
    inside = lambda node, name: text_of(next(below(node, name), None)) or None if node is not None else None
    number = lambda text: int(text) if text and text.isdigit() else None
    law = next(below(cert, "ChapterLaw"), None) if cert is not None else None
    passed = []
    for vote in below(cert, "PassedBy") if cert is not None else []:
        if date := inside(vote, "PassedDate"):
            passed.append({"chamber": "H" if (vote.get("chamber") or "").lower() == "h" else "S", "date": date, "yeas": number(inside(vote, "Yeas")), "nays": number(inside(vote, "Nays"))})
    return {
        "chapter": number(text_of(law)), "year": number(law.get("year")) if law is not None else None, "caption": inside(cert, "SessionLawCaption"), "effective_date": inside(cert, "EffectiveDate"), "partial_veto": cert is not None and next(below(cert, "VetoAction"), None) is not None,
        "passed": passed, "approved_date": inside(cert, "ApprovedDate"), "filed_date": inside(cert, "FiledDate"), "governor": inside(cert, "Governor"), "history": [t for p in below(history, "P") if (t := text_of(p))] if history is not None else [],
    }


def blocks(section_id: str, paragraphs: list[list[dict]]) -> list[dict]:
    """Blocks of a section, each with id, parent, depth, label, its mark, what it was before, and text; ids are paths of
    designators. A paragraph is a list of runs, a table a list of cells, which gives a block for each row."""
    out, ids, outline, plain = [], set(), Outline(), 0

    def unique(name: str) -> str:
        n, made = 1, name
        while made in ids:
            n += 1
            made = f"{name}~{n}"
        ids.add(made)
        return made

    for rs in paragraphs:
        if isinstance(rs, list) and rs and "row" in rs[0]:
            for line in table_lines(rs):
                plain += 1
                out.append({"block_id": unique(f"{section_id}.p{plain}"), "parent_id": None, "depth": len(outline.open) + 1, "label": None, "text": line["text"], "inserted": line["inserted"], "struck": line["struck"], "raw": line["raw"], "label_mark": None, "renumbered": None})
            continue
        text = effective(rs)
        marks, label_mark, before, rest = opening(rs)
        path = lambda: ".".join([section_id, *(m for _, m in outline.open)])
        base = {"inserted": marked(rs, "ins"), "struck": marked(rs, "del"), "raw": clean("".join(r["text"] for r in rs)), "label_mark": label_mark, "renumbered": "".join(f"({m})" for m in before) or None}
        if not marks:
            plain += 1
            if text or base["raw"]:
                out.append({"block_id": unique(f"{path()}.p{plain}"), "parent_id": path() if outline.open else None, "depth": len(outline.open) + 1, "label": None, "text": text, **base})
            continue
        for i, mark in enumerate(marks):
            depth = outline.place(mark)
            parent = path().rpartition(".")[0]
            last = i == len(marks) - 1
            out.append({"block_id": unique(path()), "parent_id": parent if parent != section_id else None, "depth": depth, "label": f"({mark})", "text": rest if last else "", **({k: v if last else "" for k, v in base.items()})})
    return out


# Kinds that a section's marked action tells, whatever its prose.
ACTION_KINDS = {"amend": "amendatory", "remd": "amendatory", "amenduncod": "amendatory", "addsect": "new", "addchap": "new", "repeal": "repealer", "effdate": "effective-date", "emerg": "emergency", "expdate": "expiration"}


def kind_by_source(source: str, action: str | None, text: str) -> str:
    """Kind of a section by its action, else its type; only new sections without an action go by their prose."""
    if action:
        return ACTION_KINDS.get(action, "other")
    return {"amendatory": "amendatory", "new": section_kind(text)}.get(source, "other")


def identity(section: dict, ordinals: dict[str, int]) -> str:
    """What a section is known by from version to version."""
    if section["action"] == "repeal" or section["kind"] == "repealer":
        cites = section["repealed"]
        key = f"repeal:{cites[0]}" + (f"+{len(cites) - 1}" if len(cites) > 1 else "") if cites else "kind:repealer"
    elif section["cite"] and section["kind"] == "amendatory":
        key = f"rcw:{section['cite']}"
    elif section["cite"] and section["kind"] == "new":
        n = ordinals["new:" + section["cite"]] = ordinals.get("new:" + section["cite"], 0) + 1
        key = f"new:{section['cite']}:{n}"
    elif section["kind"] != "new":
        key = f"kind:{section['kind']}"
    else:
        key = "text:" + hashlib.sha256(section["text"][:200].encode()).hexdigest()[:16]
    n = ordinals[key] = ordinals.get(key, 0) + 1
    return key if n == 1 else f"{key}#{n}"


def bill_section(node: ET.Element, ordinal: int, part: str | None, ordinals: dict[str, int], rows: str = "sections") -> dict:
    """A section with its blocks and tables; for `rows` cells or blocks these alone."""
    header = first(node, "BillSectionHeader")
    header = header if header is not None else ET.Element("none")
    number = text_of(first(header, "BillSectionNumber", "Value"))
    paragraphs = list(parts_of(node))
    section_id = f"sec-{number or ordinal}"
    if rows == "cells":
        return {"ordinal": ordinal, "section_id": section_id, "tables": [grid(p) for p in paragraphs if tag(p) == "Table"]}
    contents = [grid(p) if tag(p) == "Table" else runs(p) for p in paragraphs]
    made = blocks(section_id, contents)
    if rows == "blocks":
        return {"ordinal": ordinal, "section_id": section_id, "blocks": made}
    cite = next((re.sub(r"[^0-9A-Z.]", "", text_of(c).upper().replace("RCW", "").replace("CHAPTER", "").replace("TITLE", "")) for c in header.iter() if tag(c) in ("SectionCite", "ChapterCite", "TitleCite")), None)
    tables = [own for p, own in zip(paragraphs, contents, strict=True) if tag(p) == "Table"]
    text = "\n".join(b["text"] for b in made)
    action, source = node.get("action"), node.get("type", "new")
    section = {
        "ordinal": ordinal, "section_id": section_id, "num": int(number) if number.isdigit() else None, "part": part, "source_kind": source, "action": action, "cite": cite, "caption": re.sub(r"^[\s-]+|[\s.-]+$", "", text_of(first(header, "Caption"))) or None,
        "history": text_of(first(node, "History")) or None, "kind": kind_by_source(source, action, text), "text": text, "text_hash": digest(clean(text)), "veto": any(x.get("lineVeto") for x in node.iter()),
        "repealed": [m for p in paragraphs for m in re.findall(r"RCW\s+(\d+[A-Z]?\.\d+[A-Z]?\.\d+)", "".join(p.itertext()))] if action == "repeal" else [], "blocks": made, "tables": tables,
        "ins_words": sum(len(b["inserted"].split()) for b in made), "del_words": sum(len(b["struck"].strip("()").split()) for b in made),
    }
    return section | {"identity": identity(section, ordinals)}


def parse_bill_xml(source: str, rows: str = "sections") -> dict:
    """Header and sections of a Bill or a CertifiedBill; for `rows` other than sections what these are made from alone."""
    root = tree_of(source)
    if rows == "certificates":
        return {"certificate": certificate(root)}
    if rows != "sections":
        return {"sections": [bill_section(node, i, None, {}, rows) for i, node in enumerate(below(root, "BillSection"), 1)]}
    heading = next(below(root, "BillHeading"), None)
    get = lambda name: text_of(next(below(heading, name), None)) or None if heading is not None else None
    read = re.search(r"READ FIRST TIME (\d\d)/(\d\d)/(\d\d)", get("ReadDate") or "")
    sections, part, ordinals = [], None, {}
    for node in root.iter():
        if node.tag == "Part":
            part = text_of(node) or part
        elif node.tag == "BillSection":
            sections.append(bill_section(node, len(sections) + 1, part, ordinals))
    return {"long_id": get("LongBillId"), "short_id": get("ShortBillId"), "sponsors": get("Sponsors"), "session": get("Session"), "legislature": get("Legislature"), "title": text_of(next(below(root, "BillTitle"), None)) or None, "read_first": f"20{read[3]}-{read[1]}-{read[2]}" if read else None, "certified": tag(root) == "CertifiedBill", "certificate": certificate(root), "sections": sections}


def htm_runs(fragment: str) -> list[dict]:
    """Runs of an HTM paragraph by style: underlined is inserted, struck through is deleted, links are citations."""
    out: list[dict] = []
    stack = ["text"]
    for m in re.finditer(r"<(/?)([a-z0-9]+)([^>]*)>|([^<]+)", fragment, re.I):
        close, name, attrs, text = m.groups()
        if text is not None:
            t, text = stack[-1], html.unescape(text)
            if out and out[-1]["t"] == t:
                out[-1]["text"] += text
            else:
                out.append({"t": t, "text": text})
        elif close and len(stack) > 1 and name.lower() in ("span", "a", "u", "s"):
            stack.pop()
        elif not close and name.lower() in ("span", "a", "u", "s"):
            style = attrs.lower()
            stack.append("ins" if "underline" in style or name.lower() == "u" else "del" if "line-through" in style or name.lower() == "s" else "cite" if "cite=" in style and stack[-1] == "text" else stack[-1])
    return out


def parse_bill_htm(source: str) -> dict:
    """The same from an HTM file: fields stand between comments, a section begins at each BeginningSection."""
    fields = {m[1]: clean(html.unescape(re.sub(r"<[^>]*>", " ", m[2]))) for m in re.finditer(r"<!-- field: (\w+) -->(.*?)<!-- field: -->", source, re.S)}
    sections, ordinals = [], {}
    for ordinal, chunk in enumerate(re.split(r"<!-- field: BeginningSection -->", source)[1:], 1):
        paragraphs = [htm_runs(p) for p in re.findall(r"(?:^|<div[^>]*>)((?:(?!<div|</div>).)*)(?:</div>|$)", chunk, re.S)]
        paragraphs = [p for p in paragraphs if clean("".join(r["text"] for r in p))]
        head = effective(paragraphs[0]) if paragraphs else ""
        number = re.search(r"Sec\.\s*(\d+)\.", head)
        cite = re.search(r"RCW\s+(\d+[A-Z]?\.\d+[A-Z]?\.\d+)", head)
        amends = " amended to read" in head
        section_id = f"sec-{number[1] if number else ordinal}"
        made = blocks(section_id, paragraphs[1:] or paragraphs)
        text = "\n".join(b["text"] for b in made)
        section = {"ordinal": ordinal, "section_id": section_id, "num": int(number[1]) if number else None, "action": "amend" if amends else None, "cite": cite[1] if cite and amends else None, "kind": "amendatory" if amends else section_kind(head), "text": text, "text_hash": digest(clean(text)), "repealed": [], "blocks": made}
        sections.append(section | {"identity": identity(section, ordinals)})
    return {"sponsors": fields.get("Sponsors"), "title": fields.get("CaptionsTitles"), "sections": sections}


def parse_instruction(text: str) -> dict:
    """One instruction of a page-and-line amendment: operation, place and quoted texts."""
    low = text.lower()
    ops = (("strike_everything", "strike everything"), ("strike_insert", r"strike .*insert"), ("strike_section", r"strike all of section"), ("strike", "strike"), ("insert_section", r"insert the following"), ("insert", "insert"), ("renumber", "renumber"), ("correct_title", "title"))
    page, line = re.search(r"page (\d+)", low), re.search(r"line (\d+)", low)
    return {"op": next((op for op, rule in ops if re.search(rule, low, re.S)), "other"), "page": int(page[1]) if page else None, "line": int(line[1]) if line else None, "quoted": re.findall(r"[\"“]([^\"”]*)[\"”]", text)}


def parse_amendment_xml(source: str) -> dict:
    """Header, instructions or sections, and effect statement of an amendment; striking ones carry whole sections."""
    root = tree_of(source)
    get = lambda name: text_of(next(below(root, name), None)) or None
    action = get("FloorAction") or ""
    ordinals: dict[str, int] = {}
    sections = [bill_section(s, i, None, ordinals) for i, s in enumerate(below(root, "BillSection"), 1)]
    items = [text_of(p) for item in below(root, "AmendItem") for p in item if tag(p) == "P"]
    striking = any("strike everything" in x.lower() for x in items)
    date = re.search(r"(\d\d)/(\d\d)/(\d{4})", action)
    return {"type": get("AmendType"), "draft_number": get("DraftNumber"), "sponsor": get("SponsorAcronym"), "style": "striking" if striking else "page_line" if any(re.search(r"page \d+", x, re.I) for x in items) else "title", "adopted": action.upper().startswith("ADOPTED"), "disposition": action or None, "disposition_date": f"{date[3]}-{date[1]}-{date[2]}" if date else None, "effect": get("Effect"), "instructions": [parse_instruction(x) for x in items], "sections": sections}


SECTION = "ordinal int, section_id string, num int, part string, kind string, action string, cite string, caption string, identity string, text string, text_hash string, ins_words int, del_words int"
BLOCK = "ordinal int, section_id string, ord int, block_id string, parent_id string, depth int, label string, label_mark string, renumbered string, text string, inserted string, struck string"
CELL = "ordinal int, section_id string, table int, row int, column int, row_span int, column_span int, header boolean, align string, text string, inserted string, struck string"
CERTIFICATE = "chapter int, year int, caption string, effective_date string, partial_veto boolean, approved_date string, filed_date string, governor string, chamber string, date string, yeas int, nays int"
KINDS_OF_ROWS = {"sections": SECTION, "blocks": BLOCK, "cells": CELL, "certificates": CERTIFICATE}


def rows_of(document: dict, rows: str) -> Iterator[dict]:
    """Sections, their blocks, the cells of their tables, or the certificate with a row for each vote, one at least."""
    if rows == "certificates":
        if found := document.get("certificate"):
            yield from ({**found, **vote} for vote in found["passed"] or [{}])
        return
    for s in document["sections"]:
        own = {"ordinal": s["ordinal"], "section_id": s["section_id"]}
        match rows:
            case "sections":
                yield s
            case "blocks":
                yield from ({**own, "ord": i, **b} for i, b in enumerate(s["blocks"]))
            case "cells":
                yield from ({**own, "table": i, **c, "text": effective(c["runs"]), "inserted": marked(c["runs"], "ins"), "struck": marked(c["runs"], "del")} for i, t in enumerate(s.get("tables", [])) for c in t)


def parse_all(files: DataFrame, rows: str) -> DataFrame:
    """(key, error) and the sections, blocks, cells or certificates of documents (key, format, content); one that doesn't parse gives its error."""
    full = f"key string, error string, {KINDS_OF_ROWS[rows]}"
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    shape = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in full.split(", "))])
    parsers = {"xml": lambda content: parse_bill_xml(content, rows), "htm": parse_bill_htm, "amendment": parse_amendment_xml}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in shape.names]
            own = list(zip(columns, shape.names, strict=True))[2:]
            for key, form, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                error = None
                try:
                    found = list(rows_of(parsers[form](content), rows))
                except (ET.ParseError, AttributeError, KeyError, TypeError, ValueError) as e:
                    found, error = [{}], str(e)
                columns[0] += [key] * len(found)
                columns[1] += [error] * len(found)
                for column, name in own:
                    column += [r.get(name) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return files.select("key", "format", "content").mapInArrow(parsed, full)
