"""Candidate citations of a text with code point offsets.

Finders look at places where a form can start (words, mostly) and try to read it from there; what is found at a place hides
later starts of the same finder up to its end.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

from attestra.functions import fixed_values as V
from attestra.functions import scanner as S

Found = Iterator[tuple[int, int]]
_WORD = re.compile(r"\w+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'’\-]*")
_SPACED = lambda form: re.compile(form.replace(" ", r"\s+"))
_STATUTES = (_SPACED(r"lei (?:complementar )?n[º°o]?\.?\s*[\d\.\s]+[/\s]\d{4}"), *map(_SPACED, V.STATUTE_NAMES))
_LONG = tuple(map(_SPACED, V.LONG_CLASSES))
_LAW_START = re.compile(r"art(?:igo)?s?\.?\s*[\d.oils]+[º°o]?")
_LAW_PART = re.compile(r"[,\s]*(?:[§ivxl]+|\d+)[º°o]?(?:-[a-z])?|[,\s]+['\"][a-z]['\"]")
_OF_STATUTE = re.compile(r"[,\s]+(?:d[aoe]\s+)?")
_YEAR_GAP, _NAME_GAP = 60, 40


class Text:
    """A text, its lower-case form and the places of its words."""

    def __init__(self, text: str):
        self.text, self.low = text, S.lowered(text)
        self.words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(self.low)]
        self._region = (0, 0, S.NONE)

    def chain_starts(self, inside: bool) -> Iterator[tuple[int, int]]:
        """Where a class chain can start and where its first class does; inside words too where a word ends in an ordinal."""
        classes = S.class_spellings()
        for start, end, word in self.words:
            if word in classes:
                yield start, start
            elif word.endswith(V.ORDINALS) and (first := S.parted(self.low, end)) != S.NONE:
                ordinal = next(o for o in V.ORDINALS if word.endswith(o))
                if inside or word == ordinal:
                    yield end - len(ordinal), first

    def last_number(self, word: int) -> int:
        """The last place at least three characters on in the words and white space around a word where a number is read, or NONE."""
        low = self.low
        within = lambda k: low[k].isspace() or S.in_word(low, k)
        if not self._region[0] <= word < self._region[1]:
            begin = end = word
            while end < len(low) and within(end):
                end += 1
            while begin > 0 and within(begin - 1):
                begin -= 1
            last = next((k for k in range(end - 1, begin, -1) if low[k - 1].isspace() and S.marked_number(self.text, k) != S.NONE), S.NONE)
            self._region = (begin, end, last)
        return self._region[2] if self._region[2] >= word + 3 else S.NONE


def _laws(t: Text) -> Found:
    at = t.low.find("art")
    while at >= 0:
        end = at + 3
        if m := _LAW_START.match(t.low, at):
            end = m.end()
            while (part := _LAW_PART.match(t.low, end)) and part.end() > end:
                end = part.end()
            if of := _OF_STATUTE.match(t.low, end):
                named = next((n for statute in _STATUTES if (n := statute.match(t.low, of.end()))), None)
                end = named.end() if named else end
            yield at, end
        at = t.low.find("art", end)


def _behind_word(t: Text, words: tuple[str, ...], dotted: bool, read: Callable[[int], int]) -> Found:
    for start, end, word in t.words:
        if word in words:
            for stop in (end + 1, end) if dotted and t.low[end : end + 1] == "." else (end,):
                first = S.parted(t.low, stop)
                if first != S.NONE and (found := read(first)) != S.NONE:
                    yield start, found
                    break


def _then(t: Text, end: int, *steps: tuple[str, ...]) -> int:
    """Behind words that follow one by one, each one of a step's; the same place if they don't."""
    at = end
    for step in steps:
        at = S.parted(t.low, at)
        word = next((w for w in step if at != S.NONE and t.low.startswith(w, at)), None)
        if word is None:
            return end
        at += len(word)
    return at


def _summaries(t: Text) -> Found:
    def read(at: int) -> int:
        binding = S.parted(t.low, at + 10) if t.low.startswith("vinculante", at) else S.NONE
        for start in (binding, at):
            if start != S.NONE and (end := S.marked_number(t.text, start, False)) != S.NONE:
                return _then(t, end, ("da", "do", "de"), ("stf", "stj", "tst", "tse", "stm"))
        return S.NONE

    return _behind_word(t, V.SUMMARY_WORDS, True, read)


def _themes(t: Text) -> Found:
    def read(at: int) -> int:
        end = S.marked_number(t.text, at, False)
        return end if end == S.NONE else _then(t, end, ("da", "do"), ("repercussão", "repercussao"), ("geral",))

    return _behind_word(t, V.THEME_WORDS, False, read)


def _bare_nationals(t: Text) -> Found:
    for start, end, _ in t.words:
        if t.text[start] in S.NOISY and end - start <= 7 and t.text[max(0, start - 1) : start] not in (".", "-"):
            end = S.national(t.text, start)
            if end != S.NONE:
                yield start, S.with_state(t.text, end)


def _rulings(t: Text) -> Found:
    for start, first in t.chain_starts(inside=True):
        for end in S.chain_ends(t.low, first):
            found = S.marked_number(t.text, S.gap(t.text, end))
            if found != S.NONE:
                yield start, S.with_state(t.text, found)
                break


def _hyphened(t: Text) -> Found:
    """Short words that begin with a capital, each with a hyphen behind it, and a national number."""
    for start, stop, _ in t.words:
        if stop - start > 6 or not t.text[start].isupper() or t.text[max(0, start - 1) : start] == "-":
            continue
        at, tries = start, []
        while t.text[at : at + 1] in S.LETTERS and t.text[at].isupper():
            word = S.run(t.text, at, S.LETTERS)
            hyphen = S.run(t.text, word, S.BLANKS)
            if word - at > 6 or t.text[hyphen : hyphen + 1] != "-":
                break
            at = S.run(t.text, hyphen + 1, S.BLANKS)
            tries.append(at)
        for number in reversed(tries):
            if (end := S.national(t.text, number, S.EXACT)) != S.NONE:
                label = re.search(r"(?i:processo)[ \t\xa0]+(?i:n[º°o]?\.?)[ \t\xa0]*$", t.text[max(0, start - 40) : start])
                yield start - (len(label[0]) if label else 0), S.with_state(t.text, end)
                break


def _plain(text: str, at: int) -> bool:
    """Neither a digit, dot or semicolon nor the line end before a blank line."""
    c = text[at]
    if c == "\n":
        following = S.run(text, at + 1, S.BLANKS)
        return text[following : following + 1] != "\n"
    return not (c in ".;" or c.isdecimal())


def _reporter_ends(t: Text, at: int) -> Iterator[int]:
    """Where the name can start behind da relatoria de, or behind Rel. and Min."""
    for lead in ("da", "sob", "pela", ""):
        word = S.parted(t.low, at + len(lead)) if lead and t.low.startswith(lead, at) else at if not lead else S.NONE
        if word != S.NONE and t.low.startswith("relatoria", word):
            of = S.parted(t.low, word + 9)
            if of != S.NONE and t.low[of : of + 1] == "d" and S.in_word(t.low, of + 1):
                yield S.gap(t.low, of + 2)
    if t.low.startswith("rel.", at):
        start = S.gap(t.low, at + 4)
        for title in ("ministro", "ministra", "min"):
            if t.low.startswith(title, start):
                end = start + len(title)
                yield from (S.gap(t.low, k) for k in ((end + 1, end) if t.low[end : end + 1] == "." else (end,)))
        yield start


def _name_end(t: Text, at: int) -> int:
    """Capitalised words, also with da, de or do between them."""
    m = _CAPITAL.match(t.text, at)
    if not m:
        return S.NONE
    end = m.end()
    word = S.parted(t.text, end)
    while word != S.NONE:
        linked = next((s for w in ("das", "des", "dos", "da", "de", "do") if t.text.startswith(w, word) and (s := S.parted(t.text, word + len(w))) != S.NONE), S.NONE)
        m = next((m for k in (linked, word) if k != S.NONE and (m := _CAPITAL.match(t.text, k))), None)
        if not m:
            break
        end = m.end()
        word = S.parted(t.text, end)
    return end


def _described(t: Text, at: int) -> int:
    """Behind the reporter's name, where a year and then a reporter follow what ends at a place."""
    year = at
    while year < len(t.text) and year - at < _YEAR_GAP and _plain(t.text, year):
        year += 1
    if t.text[year : year + 2] not in ("19", "20") or S.run(t.text, year, S.DIGITS) < year + 4:
        return S.NONE
    for k in range(year + 4, min(len(t.text), year + 4 + _NAME_GAP) + 1):
        for start in _reporter_ends(t, k):
            if (end := _name_end(t, start)) != S.NONE:
                return end
        if k == len(t.text) or not _plain(t.text, k):
            break
    return S.NONE


def _incomplete(t: Text) -> Found:
    if "relatoria" not in t.low and "rel." not in t.low:
        return
    starts = [(start, start + len(w)) for start, _, word in t.words if word.startswith(V.TRIGGERS) for w in V.TRIGGERS if word.startswith(w)]
    chains = [(start, None, first) for start, first in t.chain_starts(inside=False)]
    for start, end, first in sorted([(s, e, s) for s, e in starts] + chains, key=lambda x: x[0]):
        if end is None:
            ends: Iterator[int] = S.chain_ends(t.low, first)
        else:
            more = re.compile(r"\s+(?:" + "|".join(V.TRIGGER_ENDINGS) + ")").match(t.low, end) if t.low.startswith("entendimento", start) else None
            ends = iter((more.end(), end) if more else (end,))
        found = next((f for e in ends if (f := _described(t, e)) != S.NONE), S.NONE)
        if found != S.NONE:
            yield start, found


def _long_classes(t: Text) -> Found:
    """A class in full, connectors, then a number; words may stand between, and then the last number behind them counts."""
    for lead in re.finditer("agravo|embargo|recurso|suspens", t.low):
        m = next((m for form in _LONG if (m := form.match(t.low, lead.start()))), None)
        end = _long_end(t, m.end()) if m else S.NONE
        if end != S.NONE:
            yield lead.start(), S.with_state(t.text, end)


def _long_end(t: Text, at: int) -> int:
    word = at
    while word < len(t.low) and t.low[word].isspace():
        word += 1
    if word == at:
        return S.NONE
    for connector in V.LONG_CONNECTORS:
        if t.low.startswith(connector, word) and (found := _long_end(t, word + len(connector))) != S.NONE:
            return found
    if t.low[word : word + 1] in S.LETTERS and (last := t.last_number(word)) != S.NONE:
        return S.marked_number(t.text, last)
    return S.marked_number(t.text, word)


#: Finder, kind, whether it names an identifier, layer.
EXTRACTORS: tuple[tuple[Callable[[Text], Found], str, bool, str], ...] = (
    (_laws, "lei", True, "regex_camada1"),
    (_summaries, "jurisprudencia", True, "regex_camada1"),
    (_themes, "jurisprudencia", True, "regex_camada1"),
    (_bare_nationals, "jurisprudencia", True, "regex_camada1"),
    (_rulings, "jurisprudencia", True, "regex_camada1"),
    (_hyphened, "jurisprudencia", True, "regex_camada1"),
    (_incomplete, "jurisprudencia", False, "heuristica_camada2"),
    (_long_classes, "jurisprudencia", True, "heuristica_camada2"),
)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without white space and punctuation at its ends; empty if nothing is left."""
    body = text[start:end]
    kept = body.lstrip(V.SPAN_EDGES)
    start += len(body) - len(kept)
    return start, start + len(kept.rstrip(V.SPAN_EDGES))


def candidates(text: str | None) -> Iterator[tuple[int, int, str, str, bool, str]]:
    """start, end, text, kind, has identifier, layer: what all finders find, trimmed."""
    if not text:
        return
    read = Text(text)
    for find, kind, known, layer in EXTRACTORS:
        done = 0
        for begin, stop in find(read):
            if begin >= done and stop > begin:
                done = stop
                start, end = trimmed(text, begin, stop)
                if start < end:
                    yield start, end, text[start:end], kind, known, layer


def noisy(text: str | None, seed: int) -> str | None:
    """The text as scanning spoils it: some digits as letters, then stray spaces and then line ends between digits.

    Each step walks over what the one before made; the seed alone decides.
    """
    if text is None:
        return None
    draw = random.Random(seed).random
    made = [V.DIGIT_LETTER[c] if c in V.DIGIT_LETTER and draw() < V.NOISE_LETTER else c for c in text]
    for stray in (" ", "\n"):
        spoiled = made[:1]
        for before, c in zip(made, made[1:], strict=False):
            if before.isdigit() and c.isdigit() and draw() < V.NOISE_GAP:
                spoiled.append(stray)
            spoiled.append(c)
        made = spoiled
    return "".join(made)
