"""Selection: longest of a group, surprisal, rarefaction, splits and samples. Ties always end at an id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import max_surprisal
from .tables import numbered_rows, running_sums


def n_lines(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)))


def loc(text: Column) -> Column:
    """Non-empty lines."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(F.translate(x, "\t\r\x0b\x0c", ""))) > 0))


#: How the four rules of the longest in a group measure, and whether a missing group is each row's own.
RULES = {"lines": (n_lines, False), "content": (F.length, True), "text": (F.length, False), "loc": (loc, False)}


def longest_per_group(df: DataFrame, rule: str, group: str, id_col: str, text_col: str) -> DataFrame:
    """The row of each group with the longest text by the rule; of equals the one of the least id."""
    measure, own = RULES[rule]
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("own:"), F.col(id_col).cast("string"))) if own else F.col(group).cast("string")
    # The measure and the id alone go through the aggregation; max_by would carry texts.
    sized = df.select(key.alias("_key"), measure(F.col(text_col)).alias("_size"), F.col(id_col).alias("_pick"))
    best = sized.groupBy("_key").agg(F.min(F.struct((-F.col("_size")).alias("s"), F.col("_pick").alias("i"))).alias("b")).select(F.col("b.i").alias(id_col))
    return df.join(best, id_col, "left_semi")


def top_surprisal(features: DataFrame, examples: DataFrame, fraction: float, kind: str = "kind", present: DataFrame | None = None) -> DataFrame:
    """doc, kind, best_rank of the selected examples (doc, kind).

    Within a kind and metric examples are ranked by surprisal; an example's rank is its best one, and the best
    max(1, ceil(fraction * n)) rankable ones of a kind stay. A kind with no rankable example keeps all of them. Ranks are
    running counts over ranges, so a kind that has most examples isn't sorted in one task. present: see max_surprisal().
    """
    surprisal = max_surprisal(features, "doc", kind, present).withColumn("_down", -F.col("surprisal"))
    ranked = running_sums(surprisal.select("doc", kind, "metric", "_down"), [kind, "metric"], ["_down", "doc"])
    best = ranked.groupBy("doc", kind).agg(F.min("_upto").cast("int").alias("best_rank"))
    placed = running_sums(best, [kind], ["best_rank", "doc"])
    sizes = placed.groupBy(F.col(kind).alias("_kind")).agg(F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.count("*"))).alias("_kept"))  # a row for each kind
    selected = placed.join(F.broadcast(sizes), F.col(kind).eqNullSafe(F.col("_kind"))).filter("_upto <= _kept").select("doc", kind, "best_rank")
    whole = examples.join(F.broadcast(sizes), F.col(kind).eqNullSafe(F.col("_kind")), "left_anti").select("doc", kind, F.lit(None).cast("int").alias("best_rank"))
    return selected.unionByName(whole)


def supported_metrics(features: DataFrame, wanted: list[str] | None, supported: list[str]) -> DataFrame:
    """features of the metrics that are both wanted (None: all) and supported."""
    return features.filter(F.col("metric").isin(*(m for m in supported if wanted is None or m in wanted)))


def checkpoints(n: int, factor: float = 1.5, least: int = 10) -> list[int]:
    """Geometric steps from `least` below n, and n."""
    steps, x = [], 1.0
    while x < n:
        if int(x) >= least and (not steps or int(x) != steps[-1]):
            steps.append(int(x))
        x *= factor
    return [*steps, n] if n else []


def rarefaction(features: DataFrame, steps: list[int], order: str = "ord") -> DataFrame:
    """n, metric, entropy, unique_values over the first n programs of the order, for each step.

    A value's count at a step is a running sum over the steps' slices, so each feature row is summed once however many
    steps there are.
    """
    up_to = F.array(*map(F.lit, steps))
    slice_ = F.size(F.filter(up_to, lambda s: s < F.col(order))) + 1
    sliced = features.filter(F.col(order) <= max(steps)).groupBy("metric", "value", slice_.alias("slice")).agg(F.sum("cnt").alias("c"))
    # From a slice on, up to the last step, a value counts: a row for each later step of each value.
    spread = sliced.withColumn("step", F.explode(F.sequence(F.col("slice"), F.lit(len(steps))))).groupBy("metric", "value", "step").agg(F.sum("c").alias("c"))
    h = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    return spread.groupBy("metric", "step").agg(F.greatest(F.lit(0.0), h).alias("entropy"), F.count("*").alias("unique_values")).select(F.element_at(up_to, F.col("step")).alias("n"), "metric", "entropy", "unique_values")


def rarefaction_curve(features: DataFrame, order: Column) -> DataFrame:
    """rarefaction() of all programs (doc) of features in an order, ties by doc, at checkpoints() up to the last."""
    placed = numbered_rows(features.select("doc").distinct().withColumn("_at", F.struct(order.alias("o"), "doc")), "_at")
    steps = checkpoints(placed.count())
    return rarefaction(features.join(placed.select("doc", (F.col("_n") + 1).alias("ord")), "doc"), steps or [0])


def matched_subsamples(features: DataFrame, docs: DataFrame, size: int, samples: int, group: str) -> DataFrame:
    """group, metric, mean entropy and unique values over `samples` draws of `size` documents of each group, each draw the
    first in order of a hash with the draw's number."""
    drawn = docs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    place = F.row_number().over(Window.partitionBy(group, "draw").orderBy(F.xxhash64("doc", "draw"), "doc"))
    picked = drawn.withColumn("p", place).filter(F.col("p") <= size).select(group, "draw", "doc")
    pooled = features.join(picked, "doc").groupBy(group, "draw", "metric", "value").agg(F.sum("cnt").alias("c"))
    h = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    per = pooled.groupBy(group, "draw", "metric").agg(F.greatest(F.lit(0.0), h).alias("entropy"), F.count("*").alias("u"))
    return per.groupBy(group, "metric").agg(F.avg("entropy").alias("mean_entropy"), F.avg("u").alias("mean_unique"))


def split_by_program(examples: DataFrame, program: Column, fraction: float, order: Column) -> DataFrame:
    """examples with split: the first max(1, floor(n * fraction)) programs in the given order are val, the rest train. A
    program never is on both sides."""
    named = examples.withColumn("_program", program)
    # One row for each program, ranked over ranges of the order: no task sees all programs.
    programs = numbered_rows(named.groupBy("_program").agg(F.min(order).alias("_o")).withColumn("_place", F.struct("_o", "_program")), "_place")
    cut = programs.filter(F.col("_n") < max(1, math.floor(programs.count() * fraction))).select("_program", F.lit("val").alias("_split"))
    return named.join(cut, "_program", "left").withColumn("split", F.coalesce("_split", F.lit("train"))).drop("_program", "_split")


def weighted_order(weight: Column, id_col: Column, seed: int) -> Column:
    """Key whose smallest values are a weighted sample without replacement: -log(u) / w, u uniform by a hash."""
    u = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    return -F.log(u) / weight


def shuffled(df: DataFrame, id_col: str, seed: int, limit: int | None = None) -> DataFrame:
    """Rows in order of a seeded hash of their id."""
    out = df.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return out if limit is None else out.limit(limit)
