"""Clauses and marks of bill prose, read word by word: citations, what a title's clauses do, kinds of sections."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with their dots, and commas.
WORD = r"[\p{L}\p{N}$]+(?:\.[\p{L}\p{N}]+)*|,"
#: A number with a letter or none, and its dotted parts.
NUMBERED = r"^\d{1,2}[A-Z]?(?:\.\d{2,4}[A-Za-z]?){0,2}$"


def cites_in(text: Column) -> Column:
    """Statute citations of a text, distinct: sections and chapters after RCW, then chapters, then titles before it.

    A keyword opens a list of numbers, which commas and "and" carry on and any other word ends: after RCW sections and
    chapters follow; the numbers after "chapter" must have a dot, the one after "Title" none, and both count only if
    RCW closes the list.
    """
    state = "struct<open:string,held:array<string>,after:array<string>,chapters:array<string>,titles:array<string>>"
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("open"), none.alias("held"), none.alias("after"), none.alias("chapters"), none.alias("titles")).cast(state)

    def read(s: Column, w: Column) -> Column:
        numbered = w.rlike(NUMBERED)
        dots = F.size(F.split(w, "[.]")) - 1
        opened = F.when(w == "RCW", "RCW").when(w.isin("chapter", "chapters"), "chapter").when(w.isin("Title", "Titles"), "title")
        taken = numbered & (((s["open"] == "chapter") & (dots == 1)) | ((s["open"] == "title") & (dots == 0) & (F.size(s["held"]) == 0)))
        listed = numbered & (s["open"] == "RCW") & (dots > 0)
        goes_on = taken | listed | (w.isin(",", "and") & (s["open"] != "title"))
        closed = lambda kind, field: F.when((w == "RCW") & (s["open"] == kind), F.concat(s[field], s["held"])).otherwise(s[field])
        return F.struct(
            F.coalesce(opened, F.when(goes_on, s["open"]).otherwise("")).alias("open"),
            F.when(taken, F.concat(s["held"], F.array(w))).when(goes_on, s["held"]).otherwise(none).alias("held"),
            F.when(listed, F.concat(s["after"], F.array(w))).otherwise(s["after"]).alias("after"),
            closed("chapter", "chapters").alias("chapters"),
            closed("title", "titles").alias("titles"),
        ).cast(state)

    every = F.aggregate(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), start, read)
    return F.element_at(F.transform(F.array(every), lambda s: F.array_distinct(F.concat(s["after"], s["chapters"], s["titles"]))), 1)


# The kinds of title clauses. The verb that opens a clause decides, for some with what directly follows it.
BY_VERB = {"amending": "amending", "repealing": "repealing", "decodifying": "decodifying", "recodifying": "recodifying", "adding": "adding-section"}
BY_OBJECT = {
    ("providing", "effective date"): "effective-date", ("providing", "effective dates"): "effective-date", ("providing", "expiration"): "expiration", ("declaring", "emergency"): "emergency",
    ("making", "appropriation"): "appropriation", ("making", "appropriations"): "appropriation", ("reenacting", "amending"): "reenacting-and-amending",
}
#: Little words that may stand before what a verb is about.
LITTLE = ("a", "an", "and", "the")


def clause_kind(clause: Column) -> Column:
    """What a clause of a title does: its verb and, where the verb alone doesn't tell, the one or two words that it is about."""
    every = F.regexp_extract_all(F.lower(clause), F.lit(r"([\p{L}\p{N}.]+)"), F.lit(1))

    def told(w: Column) -> Column:
        verb = F.get(w, F.lit(0))
        about = F.filter(F.slice(w, 2, 4), lambda x: ~x.isin(*LITTLE))
        new = lambda *nouns: F.exists(F.arrays_zip(w.alias("x"), F.slice(w, 2, 1 << 20).alias("y")), lambda p: (p["x"] == "new") & p["y"].isin(*nouns))
        one, two = F.get(about, F.lit(0)), F.concat_ws(" ", F.get(about, F.lit(0)), F.get(about, F.lit(1)))
        rules = [F.when((verb == "adding") & new("chapter", "chapters"), "adding-chapter"), F.when((verb == "creating") & new("section", "sections"), "creating-new-sections")]
        rules += [F.when((verb == v) & ((two if " " in x else one) == x), kind) for (v, x), kind in BY_OBJECT.items()]
        rules += [F.when(verb == v, kind) for v, kind in BY_VERB.items()]
        return F.coalesce(*rules, F.lit("other"))

    return F.element_at(F.transform(F.array(every), told), 1)


#: How the subject of a title begins.
OPENING = "an act relating to "


def title_actions(title: Column) -> Column:
    """Struct (subject, actions) of a title: what it relates to, and each of its clauses as (kind, text, cites).

    Semicolons part clauses; every one counts, one of no known kind as `other`. A title without the opening has no
    subject, and its first part is a clause like the others.
    """
    flat = F.trim(F.regexp_replace(title, r"[\s\p{Z}\x{FEFF}]+", " "))
    parts = F.transform(F.split(flat, ";"), lambda c: F.trim(c))
    first = F.get(parts, F.lit(0))
    opens = F.startswith(F.lower(F.concat(first, F.lit(" "))), F.lit(OPENING))
    bare = lambda c: F.trim(F.when(F.endswith(c, F.lit(".")), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c))
    subject = F.when(opens, F.nullif(bare(F.substr(first, F.lit(len(OPENING) + 1))), F.lit("")))
    leading = lambda c: F.when(F.startswith(c, F.lit("and ")), F.substr(c, F.lit(5))).otherwise(c)
    clauses = F.filter(F.transform(F.when(opens, F.slice(parts, 2, 1 << 20)).otherwise(parts), lambda c: bare(leading(c))), lambda c: c != "")
    return F.struct(subject.alias("subject"), F.transform(clauses, lambda c: F.struct(clause_kind(c).alias("kind"), c.alias("text"), cites_in(c).alias("cites"))).alias("actions"))


def _one_of(*choices: tuple[str, ...]) -> list[str]:
    """All phrases that take one word group of each choice."""
    return [" ".join(words) for words in product(*choices)]


TAKES_EFFECT, EXPIRES = ["take effect", "takes effect"], ["expire", "expires"]
# Kinds of new sections, in order of precedence, and what marks them: phrases that stand in the text in
# the given order, each of whole words; a star stands for the rest of a word.
SECTION_MARKS: list[tuple[str, list[tuple[str, ...]]]] = [
    ("emergency", [(f"{x} immediately",) for x in TAKES_EFFECT] + [("immediate preservation of the public peace",)]),
    ("severability", [("held invalid the remainder",), ("severab*",)]),
    ("expiration", [(x, "of this act") for x in EXPIRES] + [("of this act", x) for x in EXPIRES]),
    ("contingent", [(x, y) for x in TAKES_EFFECT for y in ("contingent*", "if")] + [("null and void",)]),
    ("appropriation", [("the sum of $*",), ("is appropriated",)] + [(x,) for x in _one_of(("appropriation", "appropriations"), ("is", "are"), ("made",))]),
    ("intent", [(x,) for x in _one_of(("legislature",), ("finds", "intends"))] + [("it is the intent",), ("the intent of the legislature",)]),
]


def _spelled(phrase: str) -> str:
    """A phrase as it stands in padded words."""
    return f" {phrase[:-1]}" if phrase.endswith("*") else f" {phrase} "


def section_kind(text: str) -> str:
    """Kind of a new section by its prose: the first whose marks stand there."""
    padded = f" {' '.join(re.findall(r'[a-z0-9$]+', text.lower()))} "

    def stands(phrases: tuple[str, ...]) -> bool:
        at = 0
        for p in phrases:
            at = padded.find(_spelled(p), at)
            if at < 0:
                return False
            at += 1
        return True

    return next((kind for kind, marks in SECTION_MARKS if any(map(stands, marks))), "new")


def section_kind_column(text: Column) -> Column:
    """The same of a column, in built-in expressions."""
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9$]+)"), F.lit(1)), " "), F.lit(" "))

    def stands(p: Column, phrases: tuple[str, ...]) -> Column:
        if len(phrases) == 1:
            return F.contains(p, F.lit(_spelled(phrases[0])))
        at = F.instr(p, F.lit(_spelled(phrases[0])))
        return (at > 0) & stands(F.substr(p, at + 1), phrases[1:])

    def told(p: Column) -> Column:
        found = F.lit("new")
        for kind, marks in reversed(SECTION_MARKS):
            hit = F.lit(False)
            for m in marks:
                hit = hit | stands(p, m)
            found = F.when(hit, kind).otherwise(found)
        return found

    return F.element_at(F.transform(F.array(padded), told), 1)
