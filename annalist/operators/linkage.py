"""Which candidate is the same thing: Fellegi–Sunter weights, estimated without labels from how often fields agree together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of agreement that may go to the driver; they are as many as the product of the fields' levels, at most.
MOST_PATTERNS = 100_000


def levels(*steps: Column) -> Column:
    """The level of agreement of a field: the number of ``steps`` from the first that holds on (so the first is the strongest), 0 if
    none holds, null if the first is null, which says that the field cannot be compared."""
    out = F.when(steps[0].isNull(), F.lit(None).cast("int"))
    for k, step in enumerate(steps):
        out = out.when(F.coalesce(step, F.lit(False)), F.lit(len(steps) - k))
    return out.otherwise(F.lit(0))


def patterns(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How many pairs have each pattern of levels (columns ``fields``; null: not comparable): the fields and n."""
    return pairs.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Weights:
    """For each field, the chance of each level among pairs that are the same (``m``) and among others (``u``); the share of the same."""

    fields: tuple[str, ...]
    m: list[np.ndarray]
    u: list[np.ndarray]
    share: float
    history: list[float] = field(default_factory=list)

    def log_odds(self, level: Mapping[str, int | None]) -> float:
        """Logarithm of the odds that a pair with these levels is the same; a field that cannot be compared says nothing."""
        total = np.log(self.share) - np.log1p(-self.share)
        for name, m, u in zip(self.fields, self.m, self.u, strict=True):
            if level[name] is not None:
                total += np.log(m[level[name]]) - np.log(u[level[name]])
        return float(total)


def estimate(counted: DataFrame, fields: Sequence[str], rounds: int = 100, share: float | None = None, smooth: float = 0.5, tolerance: float = 1e-7) -> Weights | None:
    """Weights by expectation-maximisation over the patterns of ``counted`` (from :func:`patterns`); None where there are none.

    The first guess takes stronger levels for likelier among the same, and a tenth of the pairs (or ``share``) for the same.
    ``smooth`` pairs are added to each level, so that no chance is 0. What goes to the driver are the patterns, whose number
    does not depend on that of the pairs.
    """
    rows = counted.select(*fields, "n").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of agreement: use fewer levels")
    if not rows:
        return None
    n = np.array([r.n for r in rows], float)
    at = [np.array([-1 if r[f] is None else r[f] for r in rows]) for f in fields]
    sizes = [max(int(a.max()) + 1, 2) for a in at]
    m = [(1.0 + np.arange(s)) ** 2 / ((1.0 + np.arange(s)) ** 2).sum() for s in sizes]
    u = [x[::-1].copy() for x in m]
    p = 0.1 if share is None else share
    history: list[float] = []
    for _ in range(rounds):
        log_m, log_u = np.log(p) * np.ones(len(n)), np.log1p(-p) * np.ones(len(n))
        for a, x, y in zip(at, m, u, strict=True):
            log_m += np.where(a >= 0, np.log(x)[a], 0.0)
            log_u += np.where(a >= 0, np.log(y)[a], 0.0)
        both = np.logaddexp(log_m, log_u)
        same = np.exp(log_m - both)
        history.append(float((n * both).sum()))
        for k, a in enumerate(at):
            seen = a >= 0
            for target, weight in ((m, n * same), (u, n * (1 - same))):
                total = np.bincount(a[seen], weight[seen], sizes[k]) + smooth
                target[k] = total / total.sum()
        p = float(np.clip((n * same).sum() / n.sum(), 1e-6, 1 - 1e-6))
        if len(history) > 1 and abs(history[-1] - history[-2]) <= tolerance * abs(history[-1]):
            break
    return Weights(tuple(fields), m, u, p, history)


def probability(pairs: DataFrame, weights: Weights | None, to: str = "confidence") -> DataFrame:
    """Add the probability that a pair is the same thing."""
    if weights is None:
        return pairs.withColumn(to, F.lit(None).cast("double"))
    total = F.lit(float(np.log(weights.share) - np.log1p(-weights.share)))
    for name, m, u in zip(weights.fields, weights.m, weights.u, strict=True):
        table = F.array(*[F.lit(float(x)) for x in np.log(m) - np.log(u)])
        total = total + F.coalesce(F.try_element_at(table, F.col(name) + 1), F.lit(0.0))
    return pairs.withColumn(to, 1.0 / (1.0 + F.exp(-total)))


def best(scored: DataFrame, mention: str = "mention_id", entity: str = "entity_id", certain: float = 0.9, lead: float = 0.5) -> DataFrame:
    """(mention, entity, confidence, decision): the likeliest entity of each mention. It is a match if its probability, shared out
    among the mention's candidates, is ``certain``; else it goes to review if it has ``lead``, and none decides otherwise.

    A mention is one thing: the odds of its candidates are set against one another and against none of them being right. Ties
    take the least entity. Repeated pairs count once, with their greatest probability.
    """
    once = scored.groupBy(mention, entity).agg(F.max(F.least(F.col("confidence"), F.lit(1 - 1e-12))).alias("c"))
    return _settled(once.withColumn("n", F.lit(1)), mention, entity, certain, lead)


def best_by_pattern(pairs: DataFrame, weights: Weights | None, fields: Sequence[str], mention: str = "mention_id", entity: str = "entity_id", certain: float = 0.9, lead: float = 0.5) -> DataFrame:
    """:func:`best` of :func:`probability`, for pairs that are distinct. Pairs of one pattern have one probability, so those of a mention
    and a pattern are counted before the shuffle, with the least of their entities: pairs are not shuffled."""
    counted = pairs.groupBy(mention, *fields).agg(F.count(F.lit(1)).alias("n"), F.min(entity).alias(entity))
    return _settled(probability(counted, weights).withColumn("c", F.least(F.col("confidence"), F.lit(1 - 1e-12))), mention, entity, certain, lead)


def _settled(once: DataFrame, mention: str, entity: str, certain: float, lead: float) -> DataFrame:
    """``once``: mention, entity, c and n, how many candidates have this probability, of which the entity is the least."""
    odds = once.withColumn("odds", F.col("c") / (1 - F.col("c")))
    per = odds.groupBy(mention).agg(F.sum(F.col("n") * F.col("odds")).alias("all"), F.min(F.struct((-F.col("odds")).alias("odds"), F.col(entity).alias("e"))).alias("top"))
    confidence = -F.col("top.odds") / (1 + F.col("all"))
    out = per.select(mention, F.col("top.e").alias(entity), confidence.alias("confidence"))
    return out.withColumn("decision", F.when(F.col("confidence") >= certain, "match").when(F.col("confidence") >= lead, "review").otherwise("none"))
