"""Scores of extracted fields against labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from talentgrid.functions.sections import let
from talentgrid.functions.text import answer_key


def keys(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), answer_key), lambda s: s != "")


def set_f1(wanted: Column, got: Column) -> Column:
    """F1 of two lists where an entry fits if one contains the other; 1 for nothing wanted and nothing found, else 0 if one is empty.
    The normal forms of both lists are computed once for each row, not for each pair of entries."""
    return let(F.struct(keys(wanted).alias("w"), keys(got).alias("g")), lambda k: _f1(k["w"], k["g"]))


def _f1(w: Column, g: Column) -> Column:
    near = lambda a, b: F.size(F.filter(a, lambda x: F.exists(b, lambda y: x.contains(y) | y.contains(x))))

    def f1(n: Column) -> Column:
        precision, recall = n["g"] / F.nullif(F.size(g), F.lit(0)), n["w"] / F.nullif(F.size(w), F.lit(0))
        return F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))

    score = let(F.struct(near(g, w).alias("g"), near(w, g).alias("w")), f1)
    return F.when((F.size(w) == 0) & (F.size(g) == 0), 1.0).when((F.size(w) == 0) | (F.size(g) == 0), 0.0).otherwise(score)


@F.pandas_udf(DoubleType())
def recall(wanted: pd.Series, got: pd.Series) -> pd.Series:
    """Share of wanted entries (normal forms) that are found, each found one used once: equal ones first, then containing ones."""

    def one(want: list[str], have: list[str]) -> float:
        left, rest = list(have), []
        for w in want:
            if w in left:
                left.remove(w)
            else:
                rest.append(w)
        hits = len(want) - len(rest)
        for w in rest:
            fit = next((h for h in left if w in h or h in w), None)
            if fit is not None:
                left.remove(fit)
                hits += 1
        return hits / len(want) if len(want) else 1.0

    return pd.Series([one(list(w), list(g)) for w, g in zip(wanted, got)])


def aggregate(scores: DataFrame, fields: list[str]) -> DataFrame:
    """Mean of each field over all fixtures; a missing score is zero."""
    return scores.agg(*(F.avg(F.coalesce(f, F.lit(0.0))).alias(f) for f in fields))
