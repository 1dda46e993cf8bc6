"""English stems by the published Porter2 rules, and the tokens of a text with positions."""

from __future__ import annotations

import re
from collections.abc import Set
from functools import lru_cache

# Stop words, and words whose stem the rules get wrong.
STOP = frozenset("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
VOWEL = "[aeiouy]"


def regions(w: str) -> tuple[int, int]:
    """Where the parts after the first and the second vowel-consonant pair begin."""
    m = re.match("gener|commun|arsen", w) or re.match(rf".*?{VOWEL}[^aeiouy]", w)
    r1 = m.end() if m else len(w)
    m = re.match(rf".*?{VOWEL}[^aeiouy]", w[r1:])
    return r1, r1 + m.end() if m else len(w)


def short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or word in KEPT:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word.lstrip("'"))
    r1, r2 = regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    if m := re.search("(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(VOWEL, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, to in STEP2:
        if w.endswith(end):
            w = w[: -len(end)] + to if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end, to in (*STEP3, ("ative", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to if len(w) - len(end) >= (r2 if end == "ative" else r1) else w
            break
    for end in STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4] in "st":
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def tokens(text: str | None, only: Set[str] | None = None) -> list[tuple[str, int]]:
    """(stem, position from 1) of the words but stop words, which count as positions; with `only`, of these stems alone.

    A stem begins with its word's first letter, so words that begin otherwise than all of `only` aren't stemmed.
    """
    found = enumerate(re.findall(r"[^\W_]+(?:'[^\W_]+)?", (text or "").lower()), 1)
    if only is None:
        return [(stem(w), i) for i, w in found if w not in STOP]
    first = {t[0] for t in only if t}
    return [(s, i) for i, w in found if w[0] in first and w not in STOP and (s := stem(w)) in only]
