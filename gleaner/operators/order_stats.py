"""Exact elements of a sorted column in two passes, however many distinct values it has.

A first pass makes a KLL sketch, which gives for each wanted place two values that very likely enclose it. A second
pass counts the values below each pair and writes those between them, a small share; the element is picked there, by
the same two passes again while it is not small. The counts are exact, so a sketch that missed is noticed and the
pair is widened.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleaner.sources.tables import written

#: So many values are sorted in one task at the end.
FEW = 100_000


def elements_at(values: DataFrame, places: list[int], n: int, k: int = 400, few: int = FEW) -> list[float]:
    """The elements of ``values`` (v double, without null and NaN, n rows) at ``places``, from 0."""
    if n <= few:
        ordered = [r["v"] for r in values.orderBy("v").collect()]
        return [ordered[p] for p in places]
    out: dict[int, float] = {}
    left, margin = sorted(set(places)), 3 / k
    while left:
        sketch = values.agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("s"), F.min("v").alias("least"), F.max("v").alias("most"))
        ranks = [(max(0.0, (p - 1) / n - margin), min(1.0, (p + 1) / n + margin)) for p in left]
        ask = [F.kll_sketch_get_quantile_double("s", F.lit(r)) for pair in ranks for r in pair]
        row = sketch.select("least", "most", *(a.alias(f"q{i}") for i, a in enumerate(ask))).first()
        pairs = [(row["least"] if a <= 0 else row[f"q{2 * i}"], row["most"] if b >= 1 else row[f"q{2 * i + 1}"]) for i, (a, b) in enumerate(ranks)]
        inside = F.lit(False)
        counts, seen = [], Observation()
        for i, (a, b) in enumerate(pairs):
            between = F.col("v").between(F.lit(a), F.lit(b))
            inside = inside | between
            counts += [F.count_if(F.col("v") < F.lit(a)).alias(f"below{i}"), F.count_if(between).alias(f"inside{i}")]
        kept = written(values.observe(seen, *counts).where(inside), "between")
        missed = []
        for i, (p, (a, b)) in enumerate(zip(left, pairs, strict=True)):
            below, held = seen.get[f"below{i}"], seen.get[f"inside{i}"]
            if not below <= p < below + held:
                missed.append(p)
            elif a == b:
                out[p] = a
            elif held == n:  # all values: halve by value
                out[p] = by_halves(values, p, a, b)
            else:
                out[p] = elements_at(kept.where(F.col("v").between(F.lit(a), F.lit(b))), [p - below], held, k, few)[0]
        left, margin = missed, margin * 4
    return [out[p] for p in places]


def by_halves(values: DataFrame, place: int, low: float, high: float) -> float:
    """The element at a place by halving the range of values that holds it, for columns that no sketch divides."""
    while low < high:
        middle = low + (high - low) / 2
        middle = low if middle >= high else middle
        row = values.agg(F.count_if(F.col("v") <= F.lit(middle)).alias("n"), F.max(F.when(F.col("v") <= F.lit(middle), F.col("v"))).alias("at"), F.min(F.when(F.col("v") > F.lit(middle), F.col("v"))).alias("next")).first()
        low, high = (low, row["at"]) if row["n"] > place else (row["next"], high)
    return low


def order_stats_by_sketch(rows: DataFrame, col: str = "entropy", qs: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = 400, few: int = FEW) -> DataFrame:
    """(q, value): the element at place floor(n * q), from 0, of the sorted values; 0 without any. Nulls don't count,
    NaN is larger than all numbers. Equal to ``dashboard.order_stats`` without a table of all distinct values."""
    values = rows.select(F.col(col).cast("double").alias("v")).where("v is not null")
    facts = values.agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("nan")).first()
    places = [math.floor(facts["n"] * q) for q in qs]
    real = facts["n"] - facts["nan"]
    found = dict(zip(asked := [p for p in places if p < real], elements_at(values.where(~F.isnan("v")), asked, real, k, few) if asked else [], strict=True))
    value = [found.get(p, math.nan if p < facts["n"] else 0.0) for p in places]
    return rows.sparkSession.createDataFrame(list(zip(qs, value, strict=True)), "q double, value double")
