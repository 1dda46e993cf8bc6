"""Cell formulas over slot paths.

An expression is parsed once into a tree. `evaluate` walks it over a dict of values, with wildcards, functions and
text; `compile_column` turns a tree of numbers without wildcards into one Spark expression over a map column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import fixed

Value = float | str | bool | None
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>\"[^\"]*\"?|'[^']*'?)|(?P<id>[A-Za-z_][\w.*\[\]]*)|(?P<op>>=|<=|==|!=|\S))")
_LEVELS = ({">", "<", ">=", "<=", "==", "!="}, {"+", "-"}, {"*", "/"})


def parse(source: str) -> tuple:
    """Tree of an expression: comparison, sums, products, sign, then numbers, text, calls and paths."""
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(source)]
    at = 0

    def take(*ops: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at][0] == "op" and tokens[at][1] in ops:
            at += 1
            return tokens[at - 1][1]
        return None

    def level(k: int) -> tuple:
        if k == len(_LEVELS):
            return ("neg", level(k)) if take("-") else primary()
        left = level(k + 1)
        while op := take(*_LEVELS[k]):
            left = (op, left, level(k + 1))
            if k == 0:
                break
        return left

    def primary() -> tuple:
        nonlocal at
        if at >= len(tokens):
            return ("const", None)
        kind, text = tokens[at]
        at += 1
        if kind == "num":
            return ("const", float(text))
        if kind == "str":
            return ("const", text[1:].removesuffix(text[0]))
        if kind == "id":
            if not take("("):
                return ("path", text)
            args = []
            while at < len(tokens) and not take(")"):
                args.append(level(0))
                take(",")
            return ("call", text, args)
        if text == "(":
            inner = level(0)
            take(")")
            return inner
        return ("const", None)

    return level(0)


def number(v: Value) -> float | None:
    """A value as number: true is 1, text is read like a cell's amount."""
    if v is None or isinstance(v, float):
        return v
    if isinstance(v, bool | int):
        return float(v)
    bare = re.sub(r"[\s$,%]", "", v)
    bare = re.sub(r"^\((.*)\)$", r"-\1", bare)
    return float(bare) if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", bare) else None


def truthy(v: Value) -> bool:
    return v.strip() != "" if isinstance(v, str) else bool(v)


@lru_cache(1 << 13)
def key_of(path: str) -> str:
    """Indexes in brackets are parts like any other."""
    return re.sub(r"\[(\d+|\*)\]", r".\1", path)


def pair(a: float | None, b: float | None) -> float | None:
    return None if a is None and b is None else (a or 0.0) + (b or 0.0)


_STAFF, _BIENNIUM = re.compile(r"fte\.total\.fy(\d)"), re.compile(r"(.*)\.bien(\d)")


@lru_cache(1 << 10)
def _shape(path: str, tail: str = "") -> re.Pattern:
    """What a path with wildcards matches, before a tail."""
    return re.compile(re.escape(path).replace(r"\*", "[^.]+") + tail)


def derived(values: Mapping[str, Value], key: str) -> float | None:
    """Biennia from fiscal years, staff totals from classes; the staff biennium is an average."""
    get = lambda k: number(values.get(k))
    if m := _STAFF.fullmatch(key):
        parts = [x for k, v in values.items() if re.fullmatch(rf"fteClass\.\d+\.fy{m[1]}", k) and (x := number(v)) is not None]
        return sum(parts) if parts else None
    if m := _BIENNIUM.fullmatch(key):
        years = [f"{m[1]}.fy{2 * int(m[2]) - 1}", f"{m[1]}.fy{2 * int(m[2])}"]
        if m[1] == "fte.total" and not any(y in values for y in years):
            total = pair(*[derived(values, y) for y in years])
            return None if total is None else total / 2
        return pair(*map(get, years))
    return None


def resolve(values: Mapping[str, Value], path: str) -> list[Value]:
    """Values of a path; * stands for one part, and for a biennium of a wildcard path its years count."""
    key = key_of(path)
    if "*" not in key:
        if key in values:
            return [values[key]]
        d = derived(values, key)
        return [] if d is None else [d]
    match = _shape(key).fullmatch
    found = [v for k, v in values.items() if match(k)]
    if not found and (m := _BIENNIUM.fullmatch(key)):
        match = _shape(m[1], r"\.fy\d").fullmatch
        rows = dict.fromkeys(k.rpartition(".")[0] for k in values if match(k))
        found = [derived(values, f"{r}.bien{m[2]}") for r in rows]
    return found


def _add(sign: int):
    return lambda a, b: None if a is None and b is None else (a or 0.0) + sign * (b or 0.0)


_COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
_MATH = {"+": _add(1), "-": _add(-1), "*": lambda a, b: None if a is None or b is None else a * b, "/": lambda a, b: None if a is None or not b else a / b}


def _shown(v: Value) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return "" if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def call(name: str, args: list[Value]) -> Value:
    """A function over its arguments, wildcards already expanded. An average counts empty values too."""
    nums = [x for v in args if (x := number(v)) is not None]
    match name:
        case "sum":
            return sum(nums) if nums else None
        case "avg":
            return sum(nums) / len(args) if nums else None
        case "max":
            return max(nums, default=None)
        case "min":
            return min(nums, default=None)
        case "abs":
            return max(map(abs, nums), default=None)
        case "not":
            return not truthy(args[0] if args else None)
        case "nonempty":
            return any(map(truthy, args))
        case "millions":
            return f"${fixed(abs(nums[0]) / 1e6, 1)} million" if nums else None
        case "thousands":
            return f"${int(fixed(abs(nums[0]) / 1000, 0)):,},000" if nums else None
        case "direction":
            return "does not change" if not nums or nums[0] == 0 else "increases" if nums[0] > 0 else "decreases"
        case "concat":
            return "".join(map(_shown, args))
    return None


def evaluate(tree: tuple | str, values: Mapping[str, Value]) -> Value:
    """Value of an expression. A comparison with an empty side is false."""
    if isinstance(tree, str):
        tree = parse(tree)
    match tree:
        case ("const", v):
            return v
        case ("neg", x):
            v = number(evaluate(x, values))
            return None if v is None else -v
        case ("path", p):
            found = resolve(values, p)
            return None if not found else found[0] if len(found) == 1 else number(found[0])
        case ("call", name, args):
            return call(name, [v for a in args for v in (resolve(values, a[1]) if a[0] == "path" and "*" in a[1] else [evaluate(a, values)])])
        case (op, a, b):
            x, y = number(evaluate(a, values)), number(evaluate(b, values))
            return (x is not None and y is not None and _COMPARE[op](x, y)) if op in _COMPARE else _MATH[op](x, y)


def compile_column(tree: tuple | str, values: Column) -> Column:
    """The expression over a map of numbers as one Spark expression; trees with wildcards or text raise ValueError."""
    if isinstance(tree, str):
        tree = parse(tree)
    match tree:
        case ("const", v) if v is None or isinstance(v, float):
            return F.lit(v).cast("double")
        case ("neg", x):
            return -compile_column(x, values)
        case ("path", p) if "*" not in p:
            own = F.try_element_at(values, F.lit(key_of(p)))
            if m := re.fullmatch(r"(.*)\.bien(\d)", key_of(p)):
                a, b = (F.try_element_at(values, F.lit(f"{m[1]}.fy{2 * int(m[2]) - d}")) for d in (1, 0))
                return F.coalesce(own, F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))
            return own
        case ("call", ("sum" | "avg" | "max" | "min" | "abs") as name, args):
            xs = [compile_column(a, values) for a in args]
            total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
            some = F.coalesce(*xs).isNotNull()
            if name in ("sum", "avg"):
                return F.when(some, total / len(xs) if name == "avg" else total)
            xs = [F.abs(x) for x in xs] if name == "abs" else xs
            return xs[0] if len(xs) == 1 else (F.least if name == "min" else F.greatest)(*xs)
        case (("+" | "-" | "*" | "/" | ">" | "<" | ">=" | "<=" | "==" | "!=") as op, a, b):
            x, y = compile_column(a, values), compile_column(b, values)
            if op in "+-":
                zero = F.lit(0.0)
                return F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, zero) + (F.coalesce(y, zero) if op == "+" else -F.coalesce(y, zero)))
            if op in "*/":
                return x * y if op == "*" else F.try_divide(x, y)
            return F.coalesce(_COMPARE[op](x, y), F.lit(False)).cast("double")
    raise ValueError(f"no column for {tree[0]}")


def recompute(cells: list[dict[str, Any]], values: dict[str, Value]) -> tuple[list[Value], dict[str, Value]]:
    """Results of computed cells (expr, and slot where others may read it) in order, in two passes over the same values."""
    trees = [parse(c["expr"]) for c in cells]
    now, out = dict(values), []
    for _ in range(2):
        out = []
        for c, tree in zip(cells, trees, strict=True):
            v = evaluate(tree, now)
            out.append(v)
            if c.get("slot"):
                now[key_of(c["slot"])] = v
    return out, now


RECOMPUTED = "note string, place int, slot string, value double, shown string"


def recompute_notes(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(note, place, slot, value, shown) of every computed cell, from cells (note, place, expr, slot) and values (note, path, value).

    A note's cells are taken in the order of their places, twice, so that an earlier cell sees what a later one yields
    for a slot. Expressions are parsed once in a task however many notes have them; one that can't be parsed yields
    nothing. Numbers and truth values are values, all results are shown as text. Of values that repeat a path the
    largest counts; notes without cells, and null notes, have no rows.
    """
    own = cells.where("note is not null").groupBy(F.col("note").cast("string").alias("note")).agg(F.array_sort(F.collect_list(F.struct("place", "expr", "slot"))).alias("cells"))
    # Dealt out by note, so that neither the largest values nor a note's map are dealt out again.
    known = values.where("path is not null and note is not null").select(F.col("note").cast("string").alias("note"), "path", "value").repartition("note")
    known = known.groupBy("note", "path").agg(F.max("value").alias("value"))
    known = known.groupBy("note").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("values"))
    shape = pa.schema([("note", pa.string()), ("place", pa.int32()), ("slot", pa.string()), ("value", pa.float64()), ("shown", pa.string())])

    def tree(expr: str, parsed: dict[str, tuple]) -> tuple:
        if expr not in parsed:
            try:
                parsed[expr] = parse(expr)
            except ValueError:
                parsed[expr] = ("const", None)
        return parsed[expr]

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for note, own, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now: dict[str, Value] = {key_of(k): v for k, v in known or []}
                for last in (False, True):
                    for c in own:
                        v = evaluate(tree(c["expr"] or "", parsed), now)
                        if c["slot"]:
                            now[key_of(c["slot"])] = v
                        if last:
                            out.append((note, c["place"], c["slot"], float(v) if isinstance(v, bool | int | float) else None, _shown(v)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return own.join(known, "note", "left").select("note", "cells", "values").mapInArrow(computed, RECOMPUTED)
