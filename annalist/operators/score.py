"""Scores, tiers, priorities and demand estimates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def score(weights: Mapping[str, float]) -> Column:
    """struct<score, parts>: the weighted sum of numeric columns (null counts as 0), and what each adds."""
    part = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w)) for c, w in weights.items()}
    total = sum(part.values(), F.lit(0.0))
    return F.struct(total.alias("score"), F.map_from_arrays(F.array(*[F.lit(c) for c in part]), F.array(*part.values())).alias("parts"))


def tier(rules: Sequence[tuple[str, int]], otherwise: int = 2) -> Column:
    """The tier of the first rule (SQL condition over features, tier) that holds."""
    out = F.lit(otherwise)
    for condition, t in reversed(rules):
        out = F.when(F.expr(condition), F.lit(t)).otherwise(out)
    return out


def scorer(rows: DataFrame, key: str, weights: Mapping[str, float], rules: Sequence[tuple[str, int]], judged: DataFrame | None = None, judged_column: str = "judged") -> DataFrame:
    """(key, score, parts, tier) of features: the score by ``weights``, the tier by ``rules``; neither is asked of a model.

    ``judged`` (key, ``judged_column``) is the one feature that a model may add; rows that it does not name have a null there.
    """
    known = rows if judged is None else rows.join(judged.select(key, judged_column), key, "left")
    return known.select(key, score(weights).alias("x"), tier(rules).alias("tier")).select(key, "x.score", "x.parts", "tier")


def priority(rows: DataFrame, group: Sequence[str], leading: Column, order: Sequence[Column]) -> DataFrame:
    """``rank`` within a group: rows with ``leading`` (in the window, no contact yet) first, then by ``order``."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(leading.desc(), *order)).cast("long"))


_NAME = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
_FORMULA = re.compile(r"[A-Za-z_0-9\s.+\-*/()]*")


def formula(text: str, columns: Sequence[str]) -> Column:
    """A formula of a demand model: arithmetic over whitelisted columns and numbers, nothing else."""
    if not _FORMULA.fullmatch(text) or (bad := set(_NAME.findall(text)) - set(columns)):
        raise ValueError(f"not a formula over {sorted(columns)}: {text}" + (f" ({sorted(bad)})" if _FORMULA.fullmatch(text) else ""))
    return F.expr(text)


def estimate(rows: DataFrame, text: str, inputs: Sequence[str], evidence: Column | None = None) -> DataFrame:
    """``estimate`` by the formula; none where an input is null or (``evidence``: boolean) lacks evidence."""
    known = F.lit(True)
    for c in inputs:
        known = known & F.col(c).isNotNull()
    return rows.withColumn("estimate", F.when(known if evidence is None else known & evidence, formula(text, inputs)))
