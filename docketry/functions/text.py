"""Text functions as built-in expressions: white space, digests, citations, titles, numbers, times."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it: Java's class leaves out no-break spaces and the byte-order mark.
WHITE = r"[\s\p{Z}\x{FEFF}]+"


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), make), 1)


def normalize_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, WHITE, " "), "^ | $", "")


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))


def etag(text: Column) -> Column:
    return F.concat(F.lit('"'), F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 24), F.lit('"'))


def escape_html(text: Column) -> Column:
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def safe_headline(text: Column) -> Column:
    """A headline as HTML in which nothing but <mark> is markup."""
    return F.replace(F.replace(escape_html(text), F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def cite_chapter(cite: Column) -> Column:
    """The chapter of a section's or chapter's citation; null for a title."""
    parts = F.split(cite, "[.]")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def cite_level(cite: Column) -> Column:
    """Which filter a citation serves: cite, chapter or title."""
    return F.element_at(F.array(F.lit("title"), F.lit("chapter"), F.lit("cite")), F.least(F.size(F.split(cite, "[.]")), F.lit(3)))


def parse_number(text: Column) -> Column:
    """Amount of a cell as double: parentheses or a minus are negative, $ , % fall away, other text is null."""
    bare = F.regexp_replace(text, r"[\s$,%]", "")
    value = F.regexp_replace(F.regexp_replace(bare, r"^\((.*)\)$", "-$1"), "^--", "")
    return F.when(value.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), value.try_cast("double"))


def fixed(value: float, digits: int) -> str:
    """Decimal digits of the exact binary value, halves away from zero."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def format_number(value: float | None, kind: str | None, precision: int | None = None) -> str:
    """A value as its cell shows it: money, money-thousands, fte, int, pct, or else up to two decimals."""
    if value is None or value != value:
        return ""
    size = abs(value)
    match kind:
        case "money" | "money-thousands" | "int":
            shown = f"{int(size + 0.5):,}"
        case "fte" | "pct":
            shown = fixed(size, 1 if precision is None else precision) + ("%" if kind == "pct" else "")
        case _:
            shown = f"{Decimal(fixed(size, 2)):,}"
            shown = shown.rstrip("0").rstrip(".") if "." in shown else shown
    shown = "$" + shown if kind == "money-thousands" else shown
    return shown if value >= 0 else "-" + shown if kind in ("int", "pct") else f"({shown})"


def format_column(value: Column, kind: str | None, precision: int | None = None) -> Column:
    """The same of a column of doubles. Whole amounts are native; decimals take the exact binary value, so they go by Arrow."""
    if kind in ("money", "money-thousands", "int"):
        shown = F.format_number(F.floor(F.abs(value) + 0.5), 0)
        shown = F.concat(F.lit("$"), shown) if kind == "money-thousands" else shown
        below = F.concat(F.lit("-"), shown) if kind == "int" else F.concat(F.lit("("), shown, F.lit(")"))
        return F.when(value.isNull() | F.isnan(value), "").when(value < 0, below).otherwise(shown)

    @F.pandas_udf("string")
    def shown_values(values: pd.Series) -> pd.Series:
        return values.map(lambda v: format_number(v, kind, precision))

    return shown_values(value)


def format_whole(value: Column) -> Column:
    """A whole amount with thousands separators; parentheses for negative ones. Halves go away from zero."""
    whole = F.round(value, 0)
    body = F.format_number(F.abs(whole), 0)
    return F.when(whole < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)


def pacific_to_utc(local: Column) -> Column:
    """UTC wall clock of a Pacific wall clock, both without zone. An hour that a change of clocks skips counts by the
    offset after the change, an hour that comes twice by the offset before it."""
    utc = F.to_utc_timestamp(local.cast("timestamp"), "America/Los_Angeles")
    back = F.from_utc_timestamp(utc, "America/Los_Angeles")
    return F.when(back == local.cast("timestamp"), utc).otherwise(utc - F.expr("INTERVAL 1 HOUR")).cast("timestamp_ntz")


def iso_millis(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def published_date(at: Column) -> Column:
    """A UTC time as a long US date in the Pacific zone."""
    return F.date_format(F.from_utc_timestamp(at, "America/Los_Angeles"), "MMMM d, yyyy")


def biennium_column(year: Column) -> Column:
    start = year - (year + 1) % 2
    return F.concat_ws("-", start.cast("string"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def direction(value: Column) -> Column:
    return F.when(value > 0, "increases").when(value < 0, "decreases").otherwise("does not change")


def millions(value: Column) -> Column:
    """As $1.2 million, without a sign; null for null. Tenths of the exact value, halves up."""
    return F.concat(F.lit("$"), F.format_string("%.1f", F.round((F.abs(value) / 1_000_000).cast("decimal(38,12)"), 1).cast("double")), F.lit(" million"))


def thousands(value: Column) -> Column:
    """As $1,235,000, without a sign; null for null."""
    return F.concat(F.lit("$"), F.format_number(F.floor(F.abs(value) / 1000 + 0.5), 0), F.lit(",000"))


def floor_action(text: Column) -> Column:
    """Struct of an amendment's floor action: adopted, and its date where one is given."""
    date = F.to_date(F.nullif(F.regexp_extract(text, r"(\d{2}/\d{2}/\d{4})", 1), F.lit("")), "MM/dd/yyyy")
    return F.struct(F.upper(text).startswith("ADOPTED").alias("adopted"), F.regexp_extract(F.upper(text), r"^([A-Z ]*[A-Z])", 1).alias("action"), date.alias("date"))
