"""The kernels as columns (Arrow batches), their native counterparts, and their registration for SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attestra.functions import citation_spans, keys, own_number
from attestra.functions import fields as field_kernel
from attestra.functions import fixed_values as V
from attestra.plans.schemas import CANDIDATE_SPAN, PARSED


def _arrow(fn, returns: T.DataType):
    kind = to_arrow_type(returns)

    def run(first: pa.Array, *rest: pa.Array) -> pa.Array:
        return pa.array([fn(*row) for row in zip(first.to_pylist(), *(r.to_pylist() for r in rest), strict=True)], kind)

    return F.arrow_udf(run, returns)


def _or_null(fn):
    return lambda x, *rest: None if x is None else fn(x, *rest)


def _parsed(text, kind):
    campos, changed = field_kernel.fields(text, kind)
    return {"campos": campos, "ocr_corrigido": changed}


_SPANS = T.ArrayType(CANDIDATE_SPAN)
_REPAIRED = T.StructType().add("texto", "string").add("corrigido", "boolean")

digit_key = _arrow(_or_null(lambda t: keys.digit_key(t)[0]), T.StringType())
repaired = _arrow(_or_null(lambda t: dict(zip(("texto", "corrigido"), keys.repair(t), strict=True))), _REPAIRED)
parse_fields = _arrow(_parsed, PARSED)
own_numbers = _arrow(own_number.own_numbers, T.ArrayType(T.StringType()))
class_chain = _arrow(_or_null(lambda t: keys.names(t, "class")), T.ArrayType(T.StringType()))
statute = _arrow(_or_null(keys.statute), T.StringType())
court = _arrow(_or_null(lambda t: (keys.names(t, "court") or [None])[0]), T.StringType())
comparable = _arrow(_or_null(keys.comparable), T.StringType())
signature = _arrow(_or_null(keys.signature), T.StringType())
trimmed = _arrow(_or_null(lambda t: dict(zip(("inicio", "fim"), citation_spans.trimmed(t, 0, len(t)), strict=True))), T.StructType().add("inicio", T.IntegerType()).add("fim", T.IntegerType()))
candidate_spans = _arrow(lambda t: [dict(zip(CANDIDATE_SPAN.names, s, strict=True)) for s in citation_spans.candidates(t)], _SPANS)
#: Seeded by a digest of the row's key and the seed, so that no partitioning matters.
noisy = _arrow(lambda t, key, seed: citation_spans.noisy(t, int.from_bytes(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:8], "big")), T.StringType())


class CitationSpans:
    """Table function: one row for each candidate span of a text."""

    def eval(self, text: str):
        yield from citation_spans.candidates(text)


def register(spark: SparkSession) -> None:
    """The kernels as SQL functions; citation_spans is a table function for LATERAL."""
    for name in ("digit_key", "parse_fields", "own_numbers", "class_chain", "statute", "court", "comparable", "signature"):
        spark.udf.register(name, globals()[name])
    spark.udtf.register("citation_spans", F.udtf(CitationSpans, returnType=CANDIDATE_SPAN))


def regrouped(digits: Column | str) -> Column:
    """Digits for display: the national mask for 20 of them, or else in threes from the right."""
    c = F.col(digits) if isinstance(digits, str) else digits
    masked = F.regexp_replace(c, r"^(\d{7})(\d{2})(\d{4})(\d)(\d{2})(\d{4})$", "$1-$2.$3.$4.$5.$6")
    return F.when(F.length(c) == 20, masked).otherwise(F.regexp_replace(c, r"(\d)(?=(\d{3})+$)", "$1."))


def state_suffix(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    found = F.upper(F.regexp_extract(c, r"(?U)[\s/\-\(]{1,3}([A-Za-z]{2})\)?\s*$", 1))
    return F.when(found.isin(*V.STATES), found)


def header_end(text: Column | str) -> Column:
    """Characters before the first blank line, or the label ementa, or the end of the process label's line; at most 1000."""
    c = F.col(text) if isinstance(text, str) else text
    at = lambda pattern: F.regexp_instr(c, F.lit(pattern))
    line = F.length(F.regexp_extract(c, rf"(?uis)^.*?{V.PROCESS_LABEL}[^\n]*", 0))
    blank, ementa = at(V.BLANK_LINE), at(rf"(?iuU){V.EMENTA}")
    end = F.when(blank > 0, blank - 1).when(ementa > 0, ementa - 1).when(at(f"(?iu){V.PROCESS_LABEL}") > 0, line).otherwise(F.length(c))
    return F.least(end, F.lit(V.HEADER_MOST))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, wherever the optimizer puts the whole.

    try_element_at keeps its type; get would work out the types of all within use again for each row.
    """
    return F.try_element_at(F.transform(F.array(value), use), F.lit(1))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over union of two spans; 0 for spans apart and for empty ones."""
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(both.cast("double"), (a1 - a0) + (b1 - b0) - both), F.lit(0.0))
