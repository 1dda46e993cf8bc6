"""Templates, tokens and exports: conditions and repeats in HTML, {{path}} tokens, XML and HTML documents."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence
from typing import Any

from docketry.operators.estimate import node_text
from docketry.operators.formula import evaluate, truthy


def session_labels(session: int) -> dict[str, Any]:
    """Ten fiscal years (label, year, yy), three biennia, six calendar years and the biennium of a session's year.

    The first fiscal year is the even one of the session or after it; biennia begin with the current one.
    """
    even, odd = session + session % 2, session - (session + 1) % 2
    years = range(even, even + 10)
    return {
        "fy": [{"label": f"FY {y}", "year": y, "yy": f"{y % 100:02d}"} for y in years],
        "bien": [f"{y}-{(y + 2) % 100:02d}" for y in range(odd, odd + 5, 2)],
        "cy": [f"CY {y}" for y in years[:6]],
        "biennium": f"{odd}-{(odd + 1) % 100:02d}",
    }


def resolve_token(path: str, context: Mapping[str, Any]) -> Any:
    """Value of a dotted path; indexes in brackets are from 0, the numbers after fy, bien and cy from 1. A fiscal year
    shows its label unless its year or yy is asked for."""
    now: Any = context
    parts = re.sub(r"\[(\d+)\]", r".\1", path.strip()).split(".")
    for i, part in enumerate(parts):
        if isinstance(now, Sequence) and not isinstance(now, str) and part.isdigit():
            at = int(part) - (1 if i and parts[i - 1] in ("fy", "bien", "cy") else 0)
            now = now[at] if 0 <= at < len(now) else None
        elif isinstance(now, Mapping):
            now = now.get(part)
        else:
            return None
    return now["label"] if parts[0] == "fy" and len(parts) == 2 and isinstance(now, Mapping) else now


def substitute(source: str, context: Mapping[str, Any]) -> tuple[str, list[str]]:
    """(text with tokens replaced, escaped for HTML; paths that nothing answers, which stay as they are)."""
    unknown: list[str] = []

    def one(m: re.Match) -> str:
        value = resolve_token(m[1], context)
        if value is None:
            unknown.append(m[1].strip())
            return m[0]
        return html.escape(str(value), quote=True).replace("&#x27;", "'")

    return re.sub(r"\{\{\s*([\w.\[\]]+)\s*\}\}", one, source), unknown


_ELEMENT = r"<(?P<tag>\w+)(?P<attrs>[^>]*\sdata-{name}=\"(?P<arg>[^\"]*)\"[^>]*)>(?P<body>(?:(?!</?(?P=tag)\b).)*)</(?P=tag)>"


def expand(source: str, context: Mapping[str, Any]) -> str:
    """Elements whose data-condition is false fall away; those with data-repeat come once for each element of a list,
    in which `item` and `index` are known."""

    def condition(m: re.Match) -> str:
        flat = {k: v for k, v in context.items() if isinstance(v, str | int | float | bool)}
        held = resolve_token(m["arg"], context) if re.fullmatch(r"[\w.\[\]]+", m["arg"]) else evaluate(m["arg"], flat)
        return m[0].replace(f' data-condition="{m["arg"]}"', "") if truthy(held) else ""

    def repeat(m: re.Match) -> str:
        items = resolve_token(m["arg"], context) or []
        one = m[0].replace(f' data-repeat="{m["arg"]}"', "")
        return "".join(substitute(one, {"item": x, "index": i})[0] for i, x in enumerate(items))

    source = re.sub(_ELEMENT.replace("{name}", "condition"), condition, source, flags=re.S)
    return re.sub(_ELEMENT.replace("{name}", "repeat"), repeat, source, flags=re.S)


def inventory(source: str) -> list[dict]:
    """Slots of a template in order."""
    get = lambda attrs, name: (re.search(rf'\sdata-{name}="([^"]*)"', attrs) or [None, None])[1]
    return [{"slot": get(a, "slot"), "type": get(a, "type"), "computed": get(a, "computed"), "required": "data-required" in a} for a in re.findall(r"<\w+([^>]*\sdata-slot=\"[^>]*)>", source)]


def load(source: str, context: Mapping[str, Any]) -> dict:
    """Template with conditions, repeats and tokens done: html, slots and unknown tokens."""
    text, unknown = substitute(expand(source, context), context)
    return {"html": text, "slots": inventory(text), "unknown": unknown}


TAGS = {"paragraph": "p", "bulletList": "ul", "orderedList": "ol", "listItem": "li", "noteSection": "section", "noteTable": "table", "noteRow": "tr", "noteCell": "td", "slot": "span", "blockquote": "blockquote"}


def to_html(node: Mapping[str, Any]) -> str:
    """HTML of a note document."""
    if node["type"] == "text":
        text = html.escape(node.get("text") or "", quote=False)
        for mark in node.get("marks") or []:
            t = {"bold": "strong", "italic": "em", "underline": "u"}.get(mark["type"])
            text = f"<{t}>{text}</{t}>" if t else text
        return text
    inner = "".join(map(to_html, node.get("content") or []))
    attrs = node.get("attrs") or {}
    if node["type"] == "heading":
        return f"<h{attrs.get('level', 1)}>{inner}</h{attrs.get('level', 1)}>"
    if node["type"] == "checkbox":
        return ("☑ " if attrs.get("checked") else "☐ ") + inner
    name = "th" if node["type"] == "noteCell" and attrs.get("header") else TAGS.get(node["type"])
    return f"<{name}>{inner}</{name}>" if name else inner


def html_document(doc: Mapping[str, Any], title: str) -> str:
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{to_html(doc)}</body></html>'


def export_xml(doc: Mapping[str, Any], header: Mapping[str, Any]) -> str:
    """XML of a note: its header, and each slot with path, type, raw value and shown text together."""
    field = lambda k, v: f"<{k}>{html.escape(str(v))}</{k}>"
    rows: list[str] = []

    def visit(node: Mapping[str, Any]) -> None:
        a = node.get("attrs") or {}
        if a.get("slot"):
            value = "" if a.get("value") is None else a["value"]
            rows.append(f'<Field path="{html.escape(a["slot"])}" type="{html.escape(str(a.get("slotType") or "text"))}" value="{html.escape(str(value))}">{html.escape(node_text(node))}</Field>')
            return
        for child in node.get("content") or []:
            visit(child)

    visit(doc)
    return '<?xml version="1.0" encoding="UTF-8"?><FiscalNote><Header>' + "".join(field(k, v) for k, v in header.items() if v is not None) + "</Header><Fields>" + "".join(rows) + "</Fields></FiscalNote>"

