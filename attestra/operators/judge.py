"""A judge between candidates that the rules can't part: prompt, tolerant reading of the answer, membership check.

Backends answer a prompt with text; only a scripted one is part of the engine. Answers are collected beforehand into
the map that Rules.judge takes, by the candidates' sorted ids, or asked for in Arrow batches by judged(), whose table
Rules.judge takes too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a prompt names of a candidate besides its id, and of the citation.
_NAMED = ("natureza", "tribunal", "classes_compostas", "ano", "relator", "score")
_ASKED = ("numero_normalizado", "classes_compostas", "tribunal", "uf", "ano", "relator")


class Backend(Protocol):
    def answer(self, prompt: str) -> str: ...


class Scripted:
    """Answers by a function of the prompt."""

    def __init__(self, say: Callable[[str], str]):
        self.say = say

    def answer(self, prompt: str) -> str:
        return self.say(prompt)


def prompt(excerpt: str, candidates: Sequence[dict], asked: dict | None = None) -> str:
    """The same text for the same candidates in any order; asked: the citation's own fields."""
    by_id = sorted(candidates, key=lambda c: c["id"])
    named = lambda c, *keys: " ".join(f"{k}={'/'.join(v) if isinstance(v, list) else v}" for k in keys if (v := c.get(k)) not in (None, "", []))
    lines = [f"- {c['id']}: " + named(c, *_NAMED) for c in by_id]
    fields = named(asked or {}, *_ASKED)
    ids = ", ".join(str(c["id"]) for c in by_id)
    return "\n".join(["Citation: " + " ".join(excerpt.split()), *([f"Fields: {fields}"] if fields else []), f"Ids: {ids}", *lines, 'Answer {"id_canonico": id or null, "justificativa": "..."}.'])


def answer_object(reply: str | None) -> dict:
    """The first whole JSON object in a reply, whatever stands around it; an empty one if there is none."""
    text, decoder = reply or "", json.JSONDecoder()
    for at, c in enumerate(text):
        if c == "{":
            try:
                return decoder.raw_decode(text, at)[0]
            except ValueError:
                continue
    return {}


def parsed(reply: str | None) -> Any:
    """The id that a reply names, whatever it is; None if there is none."""
    return answer_object(reply).get("id_canonico")


def valid(answer: Any, ids: Sequence[int]) -> int | None:
    """An id of the list, as a number or as its digits; nothing else, and no boolean."""
    if isinstance(answer, str) and re.fullmatch(r"\s*[0-9]+\s*", answer):
        answer = int(answer)
    return answer if isinstance(answer, int) and not isinstance(answer, bool) and answer in ids else None


def judged(undecided: DataFrame, backend: Backend) -> DataFrame:
    """trecho, ids (sorted, joined with commas), choice and reason: one answer for each excerpt with two candidates or more.

    undecided: trecho, candidatos and maybe campos. Rows that repeat an excerpt and its candidates are asked once. Only
    what a prompt names is put together and sent to Python.
    """

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = sorted({c["id"] for c in row["candidatos"]})
                said = answer_object(backend.answer(prompt(row["trecho"], row["candidatos"], row.get("campos"))))
                reason = said.get("justificativa")
                out.append((row["trecho"], row["ids"], valid(said.get("id_canonico"), ids), reason if isinstance(reason, str) else None))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["trecho", "ids", "choice", "reason"])

    ids = F.array_join(F.transform(F.sort_array(F.array_distinct(F.transform("candidatos", lambda k: k["id"]))), lambda i: i.cast("string")), ",")
    parts = lambda of, kind, names: [of[n].alias(n) for n in kind.names if n in names]
    kinds = {f.name: f.dataType for f in undecided.schema}
    kept = [F.transform("candidatos", lambda k: F.struct(*parts(k, kinds["candidatos"].elementType, ("id", *_NAMED)))).alias("candidatos")]
    if "campos" in kinds and (named := parts(F.col("campos"), kinds["campos"], _ASKED)):
        kept.append(F.struct(*named).alias("campos"))
    asked = undecided.where(F.size("candidatos") > 1).select("trecho", ids.alias("ids"), F.struct(*kept).alias("s"))
    asked = asked.groupBy("trecho", "ids").agg(F.min("s").alias("s")).select("trecho", "ids", "s.*")
    return asked.mapInArrow(run, "trecho string, ids string, choice bigint, reason string")
