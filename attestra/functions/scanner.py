"""A scanner for the forms that citations are made of.

Each function reads a text from a place on and says where a form ends: one end, or NONE, or all possible ends with the
preferred one first. Blanks are spaces, tabs and no-break spaces; a gap is blanks with at most one line end, so no form
crosses a blank line. Digits are the ASCII digits; noisy digits are those and the letters that scanning puts for them, in
either case but where the form says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from attestra.functions import fixed_values as V

NONE = -1
BLANKS = frozenset(" \t\xa0")
DIGITS = frozenset("0123456789")
EXACT = DIGITS | frozenset(V.LETTER_DIGIT)
NOISY = EXACT | frozenset(c.swapcase() for c in V.LETTER_DIGIT)
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CNJ_SIZES = (2, 4, 1, 2, 4)


def lowered(text: str) -> str:
    """The text in lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def run(text: str, at: int, of: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in of:
        at += 1
    return at


def gap(text: str, at: int) -> int:
    at = run(text, at, BLANKS)
    return run(text, at + 1, BLANKS) if text[at : at + 1] == "\n" else at


def parted(text: str, at: int) -> int:
    """Behind a gap that isn't empty."""
    end = gap(text, at)
    return end if end > at else NONE


def digit_run(text: str, at: int) -> int:
    """Noisy digits, at least one of them a digit."""
    end = run(text, at, NOISY)
    return end if end > at and not DIGITS.isdisjoint(text[at:end]) else NONE


def dots(text: str, at: int) -> int:
    """One or two dots or hyphens, with gaps around them."""
    at = gap(text, at)
    if text[at : at + 1] not in (".", "-"):
        return NONE
    at = gap(text, at + 1)
    return gap(text, at + 1) if text[at : at + 1] in (".", "-") else at


def _next_group(text: str, at: int) -> int:
    if (start := dots(text, at)) != NONE and (end := run(text, start, NOISY)) > start:
        return end
    start = run(text, at, BLANKS)
    if text[start : start + 1] == "\n":
        start = run(text, start + 1, BLANKS)
    elif not 1 <= start - at <= 2:
        return NONE
    return digit_run(text, start)


def number(text: str, at: int) -> int:
    """Groups of noisy digits, parted by dots, one or two blanks or a line end."""
    end = at = digit_run(text, at)
    while at != NONE:
        end, at = at, _next_group(text, at)
    return end


def national(text: str, at: int, of: frozenset[str] = NOISY) -> int:
    """A number of the national form: seven digits at most, then two, four, one, two and four."""
    end = run(text, at, of)
    if not 1 <= end - at <= 7:
        return NONE
    for size in _CNJ_SIZES:
        start = dots(text, end)
        if start == NONE or run(text, start, of) - start < size:
            return NONE
        end = start + size
    return NONE if in_word(text, end) else end


def _state(text: str, at: int) -> int:
    return at + 2 if text[at : at + 2] in V.STATES else NONE


def with_state(text: str, at: int) -> int:
    """Behind a state that follows by a slash, a hyphen or in parentheses; the same place if none does."""
    start = run(text, at, BLANKS)
    if text[start : start + 1] == "/" and (end := _state(text, run(text, start + 1, BLANKS))) != NONE and not in_word(text, end):
        return end
    start = gap(text, at)
    if text[start : start + 1] == "-" and (end := _state(text, run(text, start + 1, BLANKS))) != NONE and not in_word(text, end):
        return end
    if text[start : start + 1] == "(" and (end := _state(text, run(text, start + 1, BLANKS))) != NONE:
        end = run(text, end, BLANKS)
        if text[end : end + 1] == ")":
            return end + 1
    return at


def behind_mark(text: str, at: int, twice: bool = True) -> Iterator[int]:
    """Where a number can start: behind a mark like nº, n. or no (twice: n.. too), or at the place itself."""
    if text[at : at + 1] in ("n", "N"):
        for k in (at + 2, at + 1) if text[at + 1 : at + 2] in ("º", "°", "o", "O", "." if twice else "º") else (at + 1,):
            for j in (k + 1, k) if text[k : k + 1] == "." else (k,):
                yield gap(text, j)
    yield at


def marked_number(text: str, at: int, twice: bool = True) -> int:
    for start in behind_mark(text, at, twice):
        if (end := number(text, start)) != NONE:
            return end
    return NONE


@cache
def class_spellings() -> dict[str, tuple[re.Pattern, ...]]:
    """First word of a class's spelling to the forms of all such spellings, the longest first."""
    made: dict[str, list[str]] = {}
    for spelled in sorted({s.lower() for names in V.CLASSES.values() for s in names}, key=lambda s: (-len(s), s)):
        made.setdefault(re.match(r"\w+", spelled)[0], []).append(spelled)
    parts = r"(?:[ \t\xa0]+\n?[ \t\xa0]*|\n[ \t\xa0]*)"
    form = lambda s: parts.join(map(re.escape, s.removesuffix(".").split())) + (r"\.?" if s.endswith(".") else "")
    return {first: tuple(re.compile(form(s)) for s in names) for first, names in made.items()}


def class_ends(low: str, at: int) -> Iterator[int]:
    """Ends of a class's name at the start of a word of a lower-cased text."""
    if in_word(low, at - 1) or low[at - 1 : at] == "." and at:
        return
    first = at
    while in_word(low, first):
        first += 1
    for form in class_spellings().get(low[at:first], ()):
        if not (m := form.match(low, at)):
            continue
        optional = form.pattern.endswith("?") and low[m.end() - 1] == "."
        for end in (m.end(), m.end() - 1) if optional else (m.end(),):
            dotted = low[end - 1] == "."
            if dotted:
                yield end
            if low[end : end + 1] == "." and not in_word(low, end + 1):
                yield end + 1
            if not dotted and not in_word(low, end):
                yield end


def chain_ends(low: str, at: int) -> Iterator[int]:
    """Ends of classes joined by connectors or hyphens, more of them first."""
    for end in class_ends(low, at):
        starts = []
        if (word := parted(low, end)) != NONE:
            starts += [s for c in V.CONNECTORS if low.startswith(c, word) and (s := parted(low, word + len(c))) != NONE]
        hyphen = end + (low[end : end + 1] in BLANKS)
        if low[hyphen : hyphen + 1] == "-":
            starts += [hyphen + 2, hyphen + 1] if low[hyphen + 1 : hyphen + 2] in BLANKS else [hyphen + 1]
        for start in starts:
            yield from chain_ends(low, start)
        yield end
