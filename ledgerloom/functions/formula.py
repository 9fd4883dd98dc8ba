"""Literal arithmetic typed into a cell (=1+2*3): evaluated if it refers to nothing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(.))")


def evaluate(formula: str | None) -> float | None:
    """Sums, products, right-associative powers, signs and brackets; None for anything else."""
    if not formula or not formula.startswith("="):
        return None
    tokens = [(float(a) if a else b) for a, b in _TOKEN.findall(formula[1:]) if a or b.strip()]
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def total() -> float:
        value = product()
        while peek() in ("+", "-"):
            value = value + product() if take() == "+" else value - product()
        return value

    def product() -> float:
        value = signed()
        while peek() in ("*", "/"):
            value = value * signed() if take() == "*" else value / signed()
        return value

    def signed() -> float:
        if peek() in ("+", "-"):
            return signed() if take() == "+" else -signed()
        return power()

    def power() -> float:
        base = atom()
        if peek() == "^":
            take()
            return base ** signed()
        return base

    def atom() -> float:
        token = take()
        if token == "(":
            value = total()
            if take() != ")":
                raise ValueError(formula)
            return value
        if not isinstance(token, float):
            raise ValueError(formula)
        return token

    try:
        value = total()
        return float(value) if at == len(tokens) and not isinstance(value, complex) else None
    except (ValueError, IndexError, ZeroDivisionError, OverflowError):
        return None


@F.pandas_udf(DoubleType())
def _evaluate(formulas: pd.Series) -> pd.Series:
    return formulas.map(evaluate).astype("float64")


def literal_value(formula: Column) -> Column:
    value = _evaluate(formula)
    return F.when(~F.isnan(value), value)
