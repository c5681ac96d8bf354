"""Personal data: patterns propose spans, checksums confirm them, nearby words move their scores.

Spans are in code points, end exclusive. Kinds, in the order that breaks ties of start:

- email, ip, card, phone: the base kinds, found leftmost and non-overlapping per kind over the whole text. A proposal
  that its validator rejects (parts above 255, digit count, Luhn) is dropped without another try inside it. A base span
  always stays; words nearby only move its score.
- iban: country, check digits and 11 to 30 more letters or digits, confirmed by the remainder 1 modulo 97.
- ssn: ddd-dd-dddd, whose own shape proves little: it stays only with a word of its context list within reach.

Null and empty texts have no spans. Each pattern runs in time linear in the text, however it is made up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import byte_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Score before context, what a context word adds, and the least score of a span that is not of a base kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT_GAIN, KEEP, REACH = 0.25, 0.5, 48
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
SPAN_TYPE = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double"))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match always begins where a run of digits does, for the last part takes the rest of its run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest local part before it and the longest domain after it, past the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at + 1):
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                floor = m.end()
                yield start, floor
        at = text.find("@", max(at + 1, floor))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each start with the farthest end of a group that mod 97 confirms; words and numbers that follow may look like groups."""
    m = _IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        for end in (m.end(), *(k for k in range(m.end() - 1, start, -1) if text[k] == " ")):
            iban = text[start:end].replace(" ", "")
            if len(iban) < 15:
                break
            if mod97(iban):
                yield start, end
                at = end
                break
        m = _IBAN.search(text, at)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by start, then by kind as listed."""
    if not text:
        return []
    kept = []
    for kind, start, end in _proposals(text):
        near = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in CONTEXT[kind] for w in _WORD.findall(near)))
        if kind in BASE_KINDS or score >= KEEP:
            kept.append((kind, start, end, score))
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, start, end, _ in spans(text):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return text if not out else "".join(out) + text[done:]


@F.arrow_udf(SPAN_TYPE)
def _spans_udf(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t)] for part in byte_slices(texts) for t in part.to_pylist()]
    return pa.array(rows, _ARROW_SPANS)


@F.arrow_udf(T.StringType())
def _redact_udf(texts: pa.Array) -> pa.Array:
    """Null for texts that stay as they are, so that they needn't travel back."""
    return pa.array([new if (new := redacted(t)) is not t else None for part in byte_slices(texts) for t in part.to_pylist()], pa.string())


def _suspect(text: Column) -> Column:
    """Every pattern needs an ASCII digit or an @: other texts needn't leave the JVM."""
    return text.rlike("[0-9@]")


def find_pii(text: str | Column) -> Column:
    """Array of (kind, start, end, score) for a text column."""
    c = F.col(text) if isinstance(text, str) else text
    return _spans_udf(F.when(_suspect(c), c))


def redact_pii(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same columns with personal data replaced; n_chars, where there is such a column, follows. Clean texts stay as they are.

    A null text stays null, an empty one empty; repeated rows are changed alike, an empty table stays empty.
    """
    clean = F.coalesce(_redact_udf(F.when(_suspect(F.col(text)), F.col(text))), F.col(text))
    out = docs.withColumn(text, clean)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans and all spans as text.

    A null or empty text has no spans, counts of 0 and the digest of nothing. Each row is read alone, so repeated rows and
    null ids give rows of their own, an empty table gives none, and other columns are not read.
    """
    found = docs.select("doc_id", find_pii("text").alias("found"))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.col("found").alias("scored_spans"))
