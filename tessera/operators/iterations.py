"""Iterations of fine-tuning: which runs make which iteration, and how features change from one to the next."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import entropy_bits, exact_percentiles, kde


def discover(paths: list[str], seed: str, step: str) -> list[tuple[int, list[str]]]:
    """Iterations in order: 0 is all paths that the seed pattern fits, pooled; the k-th after it the path with the k-th
    smallest number that the step pattern's group gives. Without seeds or steps it is an error."""
    seeds = sorted(p for p in paths if re.search(seed, p))
    steps = sorted((int(m[1]), p) for p in paths if (m := re.search(step, p)))
    if not seeds or not steps:
        raise ValueError(f"no {'steps' if seeds else 'seeds'} among {len(paths)} runs")
    return [(0, seeds), *((k, [p]) for k, (_, p) in enumerate(steps, 1))]


def collected(iterations: list[tuple[int, list[str]]], load: Callable[[str], DataFrame]) -> DataFrame:
    """iteration, and the rows of all its runs."""
    out = None
    for number, paths in iterations:
        for path in paths:
            own = load(path).withColumn("iteration", F.lit(number))
            out = own if out is None else out.unionByName(own)
    return out


def outcome_sums(outcomes: DataFrame) -> DataFrame:
    """iteration, type, status, n: outcomes (iteration, type, status, n) of all runs of an iteration together."""
    return outcomes.groupBy("iteration", "type", "status").agg(F.sum("n").alias("n"))


def entropies(features: DataFrame) -> DataFrame:
    """iteration, metric, entropy, unique_values, total."""
    return entropy_bits(features, ["iteration", "metric"])


def distributions(features: DataFrame, low: float = 0.5, high: float = 0.99) -> DataFrame:
    """iteration, metric, mean, p90, p95 of numeric values (x, each cnt times), and low, high, the metric's percentiles over
    all iterations between which it is drawn."""
    keys = ["iteration", "metric"]
    means = features.groupBy(*keys).agg((F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt")).alias("mean"))
    tails = exact_percentiles(features, keys, "x", [0.9, 0.95], "cnt")
    ends = exact_percentiles(features, ["metric"], "x", [low, high], "cnt")
    return means.join(tails, keys).join(ends.select("metric", F.col("q0").alias("low"), F.col("q1").alias("high")), "metric").select(*keys, "mean", F.col("q0").alias("p90"), F.col("q1").alias("p95"), "low", "high")


def ridges(features: DataFrame, points: int = 200, low: float = 0.5, high: float = 0.99) -> DataFrame:
    """iteration, metric, g, density of numeric values (x, each cnt times) at points between the metric's low and high
    percentiles over all iterations."""
    ends = exact_percentiles(features, ["metric"], "x", [low, high], "cnt")
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    grid = ends.select("metric", "q0", "q1", step).select("metric", (F.col("q0") + (F.col("q1") - F.col("q0")) * F.col("k") / (points - 1)).alias("g"))
    each = features.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))))
    return kde(each, ["iteration", "metric"], "x", grid)
