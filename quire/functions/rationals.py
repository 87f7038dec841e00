"""Exact values of written numbers of any length, for the few rows whose digits pass Spark's decimals."""

from __future__ import annotations

import re
import sys
from fractions import Fraction

import pandas as pd

_NUMBER = re.compile(r"(-?)(?:(\d+)\s+)?(\d+)\s*/\s*(\d+)|(-?)(\d+)(?:\.(\d+))?")


def value(text: str | None) -> Fraction | None:
    """``w a/b``, ``a/b``, an integer or a decimal; None where it is none of these or divides by zero. A minus on a zero whole part is not a minus."""
    sys.set_int_max_str_digits(0)
    found = _NUMBER.fullmatch((text or "").strip().replace("−", "-").replace(",", ""))
    if not found:
        return None
    sign, whole, above, below, other, number, decimals = found.groups()
    if number is not None:
        return (-1 if other else 1) * Fraction(int(number + (decimals or "")), 10 ** len(decimals or ""))
    if not int(below):
        return None
    minus = sign and (whole is None or int(whole))
    return (-1 if minus else 1) * (int(whole or 0) + Fraction(int(above), int(below)))


def working(literals: pd.Series, tokens: pd.Series, given: pd.Series, answer: pd.Series) -> pd.DataFrame:
    """(answer_shown, working_hits) of responses: their literals, the tokens that count as working, the values given in the question, the answer."""
    shown, hits = [], []
    for own, wanted, asked, right in zip(literals, tokens, given, answer, strict=True):
        said = {value(v) for v in own} - {None}
        stated = {value(v) for v in (asked if asked is not None else [])} - {None}
        shown.append(value(right) in said)
        hits.append([t for t in wanted if t in set(own) or (value(t) in said and value(t) not in stated)])
    return pd.DataFrame({"answer_shown": shown, "working_hits": hits})
