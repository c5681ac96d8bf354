"""Fields of a citation or of a record's header: one kernel for both sides, so that their keys meet."""

from __future__ import annotations

import re

from attestra.functions import fixed_values as V
from attestra.functions.keys import digit_key, named, only_digits, repair, signature, signed_words, state_suffix, statute
from attestra.functions.scanner import in_word, lowered

EMPTY: dict = {
    "numero_normalizado": None, "classe": None, "classes_compostas": [], "tribunal": None, "uf": None, "diploma": None, "artigo": None,
    "paragrafo": None, "inciso": None, "alinea": None, "sumula": None, "vinculante": False, "ano": None, "relator": None, "orgao": None,
    "variantes_texto": [],
}
CHAIN = re.compile(r"[0-9](?:[0-9.\-]*[0-9])?")
#: Classes with a name that digits alone can stand for, as 515 does for SLS.
DIGIT_CLASSES = frozenset(c for c, spelled in V.CLASSES.items() if any(set(signature(s)) <= set("OLS") for s in spelled))
_ONLY_DIGITS = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])")
_NUMBER = r"([0-9oils]+)"
_SUMMARY = re.compile(rf"\.?\s+(vinculante\s+)?n?[º°o]?\.?\s*{_NUMBER}")
_ARTICLE = re.compile(r"\.?\s*([0-9oils]{1,3}(?:\.[0-9oils]{3})+|[0-9oils]+(?:\s[0-9][0-9oils]*)*)")
_PARAGRAPH, _SOLE, _AFTER_SIGN = re.compile(rf"\s*{_NUMBER}"), re.compile(r"\s+[uú]nico"), re.compile(r"\s*[uú]nico")
_ITEM = re.compile(r"\.?\s*([ivxlcm]+)\b")
_LETTER = re.compile(r"\.?\s*[\"'“]?([a-zA-Z])[\"'”]?\b")


def behind(text: str, labels: tuple[str, ...], tail: re.Pattern, whole: bool = True) -> re.Match | None:
    """What follows the first of the labels (the longer first at one place) that it fits; whole: no label starts within a word."""
    short = min(labels, key=len)
    starts = [label for label in labels if not label.startswith(short)]
    at = min((k for s in (short, *starts) if (k := text.find(s)) >= 0), default=-1)
    while at >= 0:
        if not (whole and in_word(text, at - 1)):
            for label in labels:
                if text.startswith(label, at) and (m := tail.match(text, at + len(label))):
                    return m
        at = min((k for s in (short, *starts) if (k := text.find(s, at + 1)) >= 0), default=-1)
    return None


def year(text: str) -> bool:
    return len(text) == 4 and text[:2] in ("19", "20") and text.isdigit()


def process_number(fixed: str) -> str | None:
    """All digits of a short text (four at least, and not just a year), or a long one's first chain of five or more."""
    if len(fixed) <= V.SHORT_TEXT:
        found = only_digits(fixed)
        return found if len(found) >= V.SHORT_DIGITS and not year(found) else None
    chains = (only_digits(m[0]) for m in CHAIN.finditer(fixed))
    return next((c for c in chains if len(c) >= V.LONG_DIGITS), None)


def _digits(found: re.Match | None, fixed: str, group: int = 1) -> str | None:
    """The number that was found in the lower-case form, as it stands in the text."""
    return digit_key(fixed[found.start(group) : found.end(group)])[0] or None if found else None


def law_parts(fixed: str, low: str) -> dict:
    """artigo, paragrafo, inciso and alinea of a law's citation."""
    sole = behind(low, V.PARAGRAPH_LABELS[1:], _SOLE, False) or behind(low, V.PARAGRAPH_LABELS[:1], _AFTER_SIGN, False)
    item, letter = behind(low, V.ITEM_LABELS, _ITEM), behind(fixed, V.LETTER_LABELS, _LETTER)
    return {
        "artigo": _digits(behind(low, V.ARTICLE_LABELS, _ARTICLE), fixed),
        "paragrafo": "único" if sole else _digits(behind(low, V.PARAGRAPH_LABELS, _PARAGRAPH, False), fixed),
        "inciso": item[1].upper() if item else None,
        "alinea": letter[1].lower() if letter else None,
    }


def fields(text: str | None, kind: str | None) -> tuple[dict, bool]:
    """The fields of a text and whether scanning was repaired; kind is lei or another. A null text has none."""
    if text is None:
        return dict(EMPTY), False
    fixed, changed = repair(text)
    low, words = lowered(fixed), signed_words(text)
    read, courts = named(words, "class"), named(words, "court")
    # what only digits spell is a variant of the text, but no class beside those that letters spell
    classes = read if DIGIT_CLASSES.isdisjoint(read) else named(signed_words(_ONLY_DIGITS.sub("0", text)), "class") or read
    out = EMPTY | {"classes_compostas": classes, "tribunal": courts[0] if courts else None, "uf": state_suffix(text), "classe": classes[-1] if classes else None}
    law = None
    if m := behind(low, V.SUMMARY_WORDS, _SUMMARY):
        out |= {"classe": "Súmula", "sumula": _digits(m, fixed, 2), "vinculante": bool(m[1])}
    elif kind == "lei":
        law = statute(text)
        out |= {"diploma": law} | law_parts(fixed, low)
    else:
        out["numero_normalizado"] = process_number(fixed)
    spelled = [s for c in read for s in V.CLASSES[c]] + list(V.STATUTES.get(law or "", ()))
    out["variantes_texto"] = list(dict.fromkeys(spelled))
    return out, changed
