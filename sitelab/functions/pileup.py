"""Pileup base strings to base counts, and the exact test on pooled counts.

Two steps are Arrow-batched Python functions: neither the run-length indel notation
nor the hypergeometric sum has an expression among the built-ins.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNT_FIELDS = [f"{b}_{d}" for b in "ACGT" for d in ("forward", "reverse")]

_START = re.compile(r"\^.")
_INDEL = re.compile(r"[+-](\d+)")
_ALLOWED = re.compile(r"[ACGTacgt.,*#<>Nn]*")


def plain_bases(raw: str) -> str:
    """The read bases of a pileup column without start, end and indel marks."""
    text = _START.sub("", raw).replace("$", "") if "^" in raw or "$" in raw else raw
    if "+" in text or "-" in text:
        kept, at = [], 0
        for mark in _INDEL.finditer(text):
            if mark.start() < at:
                raise ValueError(f"malformed indel in pileup bases: {raw!r}")
            kept.append(text[at : mark.start()])
            at = mark.end() + int(mark.group(1))
        text = "".join(kept) + text[at:]
    if not _ALLOWED.fullmatch(text):
        raise ValueError(f"unexpected character in pileup bases: {raw!r}")
    return text


@F.pandas_udf(T.StringType())
def _without_indels(bases: pd.Series) -> pd.Series:
    """Indel marks tell their own length, which no pattern expresses; NULL rows need nothing."""
    return bases.map(plain_bases, na_action="ignore")


def base_counts(bases: str, reference: str) -> Column:
    """Counts by base and direction; a dot or comma stands for the reference base.

    Columns of bases without an indel mark, nearly all, are counted by built-in functions.
    """
    bases, reference = F.col(bases), F.col(reference)
    marked = bases.rlike("[+-]")
    simple = F.replace(F.regexp_replace(bases, r"\^.", ""), F.lit("$"), F.lit(""))
    plain = F.when(marked, _without_indels(F.when(marked, bases))).otherwise(simple)
    wrong = F.concat(F.lit("unexpected character in pileup bases: "), bases)
    plain = F.when(plain.rlike(r"^[ACGTacgt.,*#<>Nn]*$"), plain).when(plain.isNotNull(), F.raise_error(wrong))
    count = lambda c: (F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit("")))).cast("long")
    fields = []
    for base in "ACGT":
        same = (F.upper(reference) == base).cast("long")
        fields.append((count(base) + count(".") * same).alias(f"{base}_forward"))
        fields.append((count(base.lower()) + count(",") * same).alias(f"{base}_reverse"))
    return F.struct(*fields)


_SMALL = 256
_TABLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL, dtype=np.float64)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Table for small n, Stirling series beyond."""
    n = np.asarray(n, dtype=np.float64)
    x = np.maximum(n, 1.0)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    large = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + series
    return np.where(n < _SMALL, _TABLE[np.minimum(n, _SMALL - 1).astype(np.int64)], large)


def fisher_p(a: int, b: int, c: int, d: int, tolerance: float = 1e-9) -> float:
    """Two-sided p: mass of all tables at most as likely as the observed one."""
    if min(a, b, c, d) < 0:
        raise ValueError("negative count")
    row, column, total = a + b, a + c, a + b + c + d
    if total == 0:
        return 1.0
    x = np.arange(max(0, row + column - total), min(row, column) + 1, dtype=np.float64)
    logs = -(
        log_factorial(x)
        + log_factorial(column - x)
        + log_factorial(row - x)
        + log_factorial(total - row - column + x)
    )
    logs -= logs.max()
    mass = np.exp(logs)
    observed = mass[a - int(x[0])]
    return float(min(1.0, mass[mass <= observed * (1 + tolerance)].sum() / mass.sum()))


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Each distinct table of a batch is computed once."""
    tables, place = np.unique(np.column_stack([a, b, c, d]), axis=0, return_inverse=True)
    values = np.array([fisher_p(*map(int, row)) for row in tables], dtype=np.float64)
    return pd.Series(values[place.ravel()], dtype="float64")
