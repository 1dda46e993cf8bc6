"""How searched text becomes terms: ampersands, case, accents, possessives, stems told by a dictionary, and synonyms as a graph."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folds() -> dict[str, str]:
    """Letters of the Latin blocks and the letters without marks that they consist of, by Unicode's decomposition."""
    plain = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(0xC0, 0x250)}
    return {c: p.lower() for c, p in plain.items() if p != c and p.isascii() and p.isalpha()}


FOLDS = _folds()
#: Letters that aren't composed, and what they are read as.
WHOLE = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ı": "i", "þ": "th", "ð": "d"}
SINGLE = {c: p for c, p in {**FOLDS, **WHOLE}.items() if len(p) == 1}
MANY = {c: p for c, p in {**FOLDS, **WHOLE}.items() if len(p) > 1}
#: A word: letters and digits, apostrophes within.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"

# Groups of forms that mean the same.
SYNONYMS = (
    ("b and o", "business and occupation", "business and occupations", "b o"), ("rcw", "revised code of washington"), ("wac", "washington administrative code"), ("dor", "department of revenue"),
    ("ofm", "office of financial management"), ("lsc", "legislative service center"), ("fte", "full time equivalent"), ("reet", "real estate excise tax"), ("puc", "public utility tax"),
    ("esd", "employment security department"), ("dshs", "department of social and health services"), ("l and i", "labor and industries"), ("cte", "career and technical education"), ("fiscal note", "fn"),
)


def words_of(text: str | None) -> list[str]:
    """The words of a text, folded, without possessive endings."""
    low = (text or "").replace("&", " and ").lower()
    for c, p in MANY.items():
        low = low.replace(c, p)
    low = low.translate(str.maketrans(SINGLE))
    found = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", low)
    return [re.sub(r"['’]s$", "", w).replace("’", "'") for w in found]


def words_column(text: Column) -> Column:
    """The same of a column, in built-in expressions; null text has no words."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit(" and ")))
    plain = low
    for c, p in MANY.items():
        plain = F.replace(plain, F.lit(c), F.lit(p))
    plain = F.translate(plain, "".join(SINGLE), "".join(SINGLE.values()))
    # Where letters are as many as bytes, all are ASCII and none is folded.
    low = F.when(F.length(low) == F.octet_length(low), low).otherwise(plain)
    bare = lambda w: F.when(F.endswith(w, F.lit("'s")) | F.endswith(w, F.lit("’s")), F.substr(w, F.lit(1), F.length(w) - 2)).otherwise(w)
    return F.transform(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.replace(bare(w), F.lit("’"), F.lit("'")))


def shingles(words: Column, least: int = 2, most: int = 3) -> Column:
    """Runs of `least` to `most` words, blank-joined, by place and length."""
    runs = lambda i: F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(i + n - 1 <= F.size(words), F.array_join(F.slice(words, i, n), " ")))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - (least - 1)), runs))
    return F.when(F.size(words) >= least, F.filter(every, lambda s: s.isNotNull())).otherwise(F.array().cast("array<string>"))


#: Endings that a stem may have lost and what stands in their place, tried in this order; an ending needs so many letters before it.
ENDINGS = (("ies", "y"), ("es", ""), ("es", "e"), ("s", ""), ("ied", "y"), ("ed", "e"), ("ed", ""), ("ing", ""), ("ing", "e"), ("ers", "er"), ("ly", ""))
STEM_LETTERS = 3


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, stem) of every term of a dictionary: the first shorter form that the dictionary has as well, else itself.

    A doubled consonant before an ending may be single. The forms are joined with the dictionary, so a stem is always
    a word of the texts themselves.
    """
    own = terms.select(F.col(term).alias("term")).distinct()
    forms = []
    for ending, put in ENDINGS:
        begin = F.substr("term", F.lit(1), F.length("term") - len(ending))
        fits = F.endswith("term", F.lit(ending)) & (F.length(begin) >= STEM_LETTERS) & ~(F.lit(ending == "s") & F.endswith(begin, F.lit("s")))
        forms.append(F.when(fits, F.concat(begin, F.lit(put))))
        if not put:
            doubled = (F.length(begin) > STEM_LETTERS) & (F.right(begin, F.lit(1)) == F.substr(begin, F.length(begin) - 1, F.lit(1)))
            forms.append(F.when(fits & doubled, F.substr(begin, F.lit(1), F.length(begin) - 1)))
    tried = own.select("term", F.posexplode(F.array(*forms)).alias("place", "form")).where("form is not null")
    found = tried.join(own.select(F.col("term").alias("form")), "form").groupBy("term").agg(F.min(F.struct("place", "form"))["form"].alias("stem"))
    return own.join(found, "term", "left").select("term", F.coalesce("stem", "term").alias("stem"))


def token_graph(words: Sequence[str], groups: Sequence[Sequence[str]] = SYNONYMS) -> list[list[tuple[str, ...]]]:
    """The words as positions, each with the ways to say it: a word, or, where a group's form begins, all forms of the group.

    The longest form counts where several begin at a word, and those of all groups that have it; a form that spans
    several words is one position.
    """
    ways: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for group in groups:
        forms = [tuple(words_of(form)) for form in group]
        for form in forms:
            own = ways.setdefault(form, [form])
            own += [other for other in forms if other not in own]
    longest = max(map(len, ways), default=1)
    out, at = [], 0
    while at < len(words):
        for n in range(min(longest, len(words) - at), 0, -1):
            form = tuple(words[at : at + n])
            if form in ways or n == 1:
                out.append(ways.get(form, [form]))
                at += n
                break
    return out
