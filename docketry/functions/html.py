"""Text of HTML, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import normalize_space

# The entities that legislative files use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    for name, c in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(c))
    return text


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", " ")


def html_text(html: Column) -> Column:
    """Text between the tags with white space collapsed; null is null."""
    return normalize_space(decode_entities(strip_tags(html)))
