"""Relevance formulas and score options as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n_docs: int, df: int) -> float:
    return math.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, idf_value: float, average: float) -> Column:
    """idf * tf / (tf + k1 * (1 - b + b * length / average)), 0 where tf is 0."""
    norm = K1 * (1 - B + B * length / F.lit(max(average, 1e-9)))
    return F.when(tf > 0, F.lit(idf_value) * tf / (tf + norm)).otherwise(F.lit(0.0))


def stable_tfl(tf: Column, length: Column, term: str) -> Column:
    """Needs no statistics: how likely a text of this length holds a term of this length."""
    absent = 1 - 0.00781 * 2 ** (-0.917 * len(term))
    p = 1 - F.pow(F.lit(absent), length)
    rarity = F.log(1 + (1 - p + 0.05) / (p + 0.05))
    return F.when(tf > 0, rarity * tf / (tf + 1.2)).otherwise(F.lit(0.0))


def finite(column: Column) -> Column:
    """Undefined scores (null, NaN, minus infinity) are 0."""
    return F.when(column.isNull() | F.isnan(column) | (column == float("-inf")), 0.0).otherwise(column)


def expression(spec: dict, relevance: Column, column_of) -> Column:
    """A function score; column_of(path) gives a numeric column."""
    (kind, arg), = spec.items()
    if kind == "score":
        return relevance
    if kind == "constant":
        return F.lit(float(arg))
    if kind == "path":
        path, undefined = (arg, 0.0) if isinstance(arg, str) else (arg["value"], float(arg.get("undefined", 0)))
        return F.coalesce(column_of(path).cast("double"), F.lit(undefined))
    if kind in ("add", "multiply"):
        parts = [expression(x, relevance, column_of) for x in arg]
        out = parts[0]
        for p in parts[1:]:
            out = out + p if kind == "add" else out * p
        return out
    if kind in ("log", "log1p"):
        x = expression(arg, relevance, column_of)
        x = x + 1 if kind == "log1p" else x
        return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    if kind == "gauss":
        x = expression({"path": arg["path"]}, relevance, column_of)
        far = F.greatest(F.lit(0.0), F.abs(x - float(arg["origin"])) - float(arg.get("offset", 0)))
        return F.exp(far * far / F.lit(float(arg["scale"]) ** 2 / math.log(float(arg.get("decay", 0.5)))))
    raise ValueError(f"unknown expression {kind}")


def apply(option: dict | None, relevance: Column, column_of) -> Column:
    """The score after an operator's score option."""
    if not option:
        return relevance
    (kind, arg), = option.items()
    if kind == "constant":
        return F.lit(float(arg["value"]))
    if kind == "boost":
        if "path" in arg:
            return relevance * F.coalesce(column_of(arg["path"]).cast("double"), F.lit(float(arg.get("undefined", 0))))
        return relevance * float(arg["value"])
    if kind == "function":
        return finite(expression(arg, relevance, column_of))
    raise ValueError(f"unknown score option {kind}")
