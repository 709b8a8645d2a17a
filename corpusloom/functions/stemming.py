"""The English stemmer of the Snowball project ("Porter2"), written from its published definition."""

from __future__ import annotations

import re
from functools import lru_cache

# Words the definition lists with their stems, and words that stay as they are.
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_STAY = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_STAY_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings of steps 2, 3 and 4 with what takes their place, the longer ones first.
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_LATE_REGION = re.compile(r"gener|commun|arsen")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", re.S)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a word in lower case."""
    if len(word) <= 2 or word in _STAY:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    late = _LATE_REGION.match(w)
    first = late.end() if late else (m.end() if (m := _REGION.search(w)) else len(w))
    second = m.end() if (m := _REGION.search(w, first)) else len(w)

    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _STAY_AFTER_PLURAL:
        return w
    # 1b: past and present participles
    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= first:
            w = w[: -len(ending)] + "ee"
    elif ending and _VOWEL.search(w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= first and _SHORT_END.match(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2 and 3: compound endings behind the first region
    for number, table in ((2, _STEP2), (3, _STEP3)):
        hit = next(((e, put) for e, put in table if w.endswith(e)), None)
        if hit and len(w) - len(hit[0]) >= first:
            ending, put = hit
            before = w[: -len(ending)]
            if (ending == "ogi" and not before.endswith("l")) or (number == 2 and ending == "li" and before[-1:] not in tuple("cdeghkmnrt")) or (ending == "ative" and len(before) < second):
                continue
            w = before + put
    # 4: endings behind the second region
    ending = next((e for e in _STEP4 if w.endswith(e)), None)
    if ending and len(w) - len(ending) >= second and (ending != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(ending)]
    # 5
    if w.endswith("e") and (len(w) > second or (len(w) > first and not _SHORT_END.match(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > second:
        w = w[:-1]
    return w.lower()
