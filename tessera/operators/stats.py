"""Group statistics: counts and rates with intervals, entropy, pass@k, distributions.

All are partial aggregations followed by one small shuffle; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Steps, frequent, running_sums

Z = 1.96
#: Values, the most frequent ones, that are sent to all tasks where a feature's rows are rated.
HOT = 65_536


def wilson(successes: Column, n: Column, clamp: bool = True) -> tuple[Column, Column]:
    """Wilson score interval; (0, 0) for n = 0."""
    p, z2 = successes / n, Z * Z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low, high = centre - half, centre + half
    if clamp:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    zero = F.lit(0.0)
    return F.when(n > 0, low).otherwise(zero), F.when(n > 0, high).otherwise(zero)


def success_rate(df: DataFrame, keys: list[str], success: Column, clamp: bool = True) -> DataFrame:
    """keys, n, successes, rate, ci_low, ci_high."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(success.cast("long")).alias("successes"))
    low, high = wilson(F.col("successes"), F.col("n"), clamp)
    return out.select(*keys, "n", "successes", (F.col("successes") / F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def grouping_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts in all, by a, by b and by both in one pass; missing values are 'unknown'. level: 0 both, 1 a, 2 b, 3 all."""
    filled = df.select(F.coalesce(F.col(a), F.lit("unknown")).alias(a), F.coalesce(F.col(b), F.lit("unknown")).alias(b))
    return filled.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")).select(a, b, "level", "n")


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row with a column for each of the given values, and a total. Known values save a pass."""
    return df.groupBy(row).agg(*(F.sum((F.col(column) == v).cast("long")).alias(v) for v in values), F.count("*").alias("total"))


def shares(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """outer, inner, n, share of outer's rows."""
    counts = df.groupBy(outer, inner).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(outer)))


def entropy_bits(features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entropy, unique, total from rows keys, value, cnt: log2(T) - sum(c log2 c) / T, never below 0."""
    pooled = features.groupBy(*keys, "value").agg(F.sum("cnt").alias("c"))
    h = F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")
    return pooled.groupBy(*keys).agg(F.greatest(F.lit(0.0), h).alias("entropy"), F.count("*").alias("unique_values"), F.sum("c").alias("total"))


def max_surprisal(features: DataFrame, doc: str = "doc", kind: str = "kind", present: DataFrame | None = None) -> DataFrame:
    """doc, kind, metric, surprisal: the largest log2(T / c) of a document's values, against the counts of its kind.

    present: the values that each document has, if known without counts (fewer rows than features). The rates of the HOT
    most frequent values go to all tasks, so their rows are reduced to a maximum a document where they lie; the others
    have no hot key and are joined by a shuffle.
    """
    keys = [kind, "metric", "value"]
    counts = features.groupBy(*keys).agg(F.sum("cnt").alias("c"))
    pooled = Steps(features.sparkSession).add(counts)
    whole = pooled.groupBy(F.col(kind).alias("_k"), F.col("metric").alias("_m")).agg(F.sum("c").alias("t"))  # a row for each kind and metric
    sized = pooled.join(F.broadcast(whole), F.col(kind).eqNullSafe(F.col("_k")) & (F.col("metric") == F.col("_m")))
    rated = sized.select(F.col(kind).alias("_kind"), F.col("metric").alias("_metric"), F.col("value").alias("_value"), "c", F.log2(F.col("t") / F.col("c")).alias("s"))
    hot = F.broadcast(frequent(rated, "c", HOT).drop("c"))
    own = (present if present is not None else features).select(doc, *keys)
    same = F.col(kind).eqNullSafe(F.col("_kind")) & (F.col("metric") == F.col("_metric")) & (F.col("value") == F.col("_value"))
    near = own.join(hot, same).groupBy(doc, kind, "metric").agg(F.max("s").alias("s"))
    far = own.join(hot, same, "left_anti").join(rated.drop("c"), same).groupBy(doc, kind, "metric").agg(F.max("s").alias("s"))
    return near.unionByName(far).groupBy(doc, kind, "metric").agg(F.max("s").alias("surprisal"))


def surprisal_against(features: DataFrame, reference: DataFrame) -> DataFrame:
    """As max_surprisal(), against the counts of another table; a value it hasn't is infinitely surprising."""
    pooled = reference.groupBy("metric", "value").agg(F.sum("cnt").alias("c"))
    rated = pooled.withColumn("s", F.log2(F.sum("c").over(Window.partitionBy("metric")) / F.col("c"))).select("metric", "value", "s")
    joined = features.join(rated, ["metric", "value"], "left")
    return joined.groupBy("doc", "metric").agg(F.max(F.coalesce("s", F.lit(float("inf")))).alias("surprisal"))


def novelty(features: DataFrame, order: str = "ord") -> DataFrame:
    """metric, unique_values, total, p_new (unique by total), p_any_new: share of programs that bring a value first seen
    with them, in the given order."""
    first = features.groupBy("metric", "value").agg(F.min(order).alias("first"), F.sum("cnt").alias("c"))
    values = first.groupBy("metric").agg(F.count("*").alias("unique_values"), F.sum("c").alias("total"), F.countDistinct("first").alias("bringers"))
    programs = features.agg(F.countDistinct(order).alias("programs"))
    sized = values.join(F.broadcast(programs))  # one row
    return sized.select("metric", "unique_values", "total", (F.col("unique_values") / F.col("total")).alias("p_new"), (F.col("bringers") / F.col("programs")).alias("p_any_new"))


def exact_percentiles(df: DataFrame, keys: list[str], x: str, shares: list[float], count: str | None = None) -> DataFrame:
    """keys, q0, q1, ...: percentiles of x, between neighbours in proportion, as numpy gives them. Values are counted, then
    summed in order over ranges, so no task holds a group's values. count: how often a row's value counts."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg((F.sum(count) if count else F.count("*")).cast("long").alias("_c"))
    sums = running_sums(counts, keys, [x], "_c")
    whole = sums.groupBy(*keys).agg(F.max("_upto").alias("_t")).select(F.struct(*keys).alias("_k"), "_t")
    placed = sums.join(F.broadcast(whole), F.struct(*keys).eqNullSafe(F.col("_k")))  # a row for each group
    at = [(F.lit(float(q)) * (F.col("_t") - 1)) for q in shares]
    ends = [F.min(F.when(F.col("_upto") > f(p), F.col(x))).alias(f"_{n}{i}") for i, p in enumerate(at) for n, f in (("l", F.floor), ("h", F.ceil))]
    out = placed.groupBy(*keys).agg(F.max("_t").alias("_t"), *ends)
    return out.select(*keys, *((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (p - F.floor(p))).alias(f"q{i}") for i, p in enumerate(at)))


def two_level(features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, p90, p95 of per-program means of a numeric metric: rows keys, doc, x, cnt."""
    per = features.groupBy(*keys, "doc").agg((F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt")).alias("m"))
    means = per.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.avg("m").alias("mean"))
    both = exact_percentiles(per, keys, "m", [0.9, 0.95]).join(means, F.struct(*keys).eqNullSafe(F.struct(*(f"_{k}" for k in keys))))
    return both.select(*keys, "mean", F.col("q0").alias("p90"), F.col("q1").alias("p95"))


def pass_at_k(results: DataFrame, keys: list[str], ks: list[int], drop_above_max: bool = False) -> DataFrame:
    """keys, k, share of rows that succeed within k attempts; rows success, num_attempts. With drop_above_max, only ks up
    to the group's largest number of attempts."""
    out = results.groupBy(*keys).agg(F.max("num_attempts").alias("_most"), *(F.avg((F.col("success") & (F.col("num_attempts") <= k)).cast("double")).alias(f"_{k}") for k in ks))
    out = out.select(*keys, "_most", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("p")) for k in ks))).alias("e"))
    if drop_above_max:
        out = out.filter(F.col("e.k") <= F.col("_most"))
    return out.select(*keys, F.col("e.k").alias("k"), F.col("e.p").alias("pass_at_k"))


def cumulative_success(results: DataFrame, model: str, most: int) -> DataFrame:
    """model, attempt, solved: rows that succeed at that attempt or before."""
    solved = results.filter("success").groupBy(model, "num_attempts").agg(F.count("*").alias("n"))
    grid = results.select(model).distinct().withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(most))))
    sums = grid.join(solved, model, "left").groupBy(model, "attempt").agg(F.sum(F.when(F.col("num_attempts") <= F.col("attempt"), F.col("n"))).alias("solved"))
    return sums.select(model, "attempt", F.coalesce("solved", F.lit(0)).alias("solved"))


def distribution(df: DataFrame, key: str, k: str) -> DataFrame:
    """key, k, n_exact, n_at_least."""
    counts = df.groupBy(key, k).agg(F.count("*").alias("n_exact"))
    down = Window.partitionBy(key).orderBy(F.desc(k)).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("n_at_least", F.sum("n_exact").over(down))


def repair_classes(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, no_repair, repaired, all_failed: tasks done without a repair, those whose last verification after repairs
    succeeded, and those whose last one didn't. Rows: repair_attempts, work_status, verification (array of outcomes)."""
    tried = F.size(F.coalesce("verification", F.array().cast("array<string>"))) > 0
    won = F.coalesce(F.try_element_at("verification", F.lit(-1)) == "SUCCESS", F.lit(False))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return tasks.groupBy(*keys).agg(count((F.col("repair_attempts") == 0) & (F.col("work_status") == "DONE")).alias("no_repair"), count(tried & won).alias("repaired"), count(tried & ~won).alias("all_failed"))


def spec_counts(source: Column) -> dict[str, Column]:
    """Of a program: code_lines (neither blank nor a comment), declarations with a postcondition before their body, asserts
    and invariants that begin a line."""
    lines = F.filter(F.transform(F.split(source, "\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("//"))
    begins = lambda w: F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(rf"^{w}\b"))))
    heads = F.regexp_extract_all(source, F.lit(r"(?s)\b(?:method|function|lemma|predicate)\b(?=([^{]*))"), F.lit(1))
    return {"code_lines": F.size(lines), "with_ensures": F.size(F.filter(heads, lambda h: F.regexp_like(h, F.lit(r"\bensures\b")))), "asserts": begins("assert"), "invariants": begins("invariant")}


def top_values(features: DataFrame, n: int, datasets: list[str], column: str = "dataset") -> DataFrame:
    """value, a count for each dataset, total: the n values of the largest total, ties by value."""
    wide = features.groupBy("value").agg(*(F.sum(F.when(F.col(column) == d, F.col("cnt")).otherwise(0)).alias(d) for d in datasets), F.sum("cnt").alias("total"))
    return wide.orderBy(F.desc("total"), "value").limit(n)


def top_shares(features: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """keys, value, c, share, place: each group's n most common values, ties by value."""
    pooled = features.groupBy(*keys, "value").agg(F.sum("cnt").alias("c"))
    shared = pooled.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
    return shared.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "value"))).filter(F.col("place") <= n)


def kde(df: DataFrame, keys: list[str], x: str, grid: list[float] | DataFrame, most: int = 20_000) -> DataFrame:
    """keys, g, density on a grid (numbers, or a table of g by some of the keys), with Silverman's bandwidth
    0.9 min(sd, iqr / 1.34) n^-0.2. Groups over `most` rows are estimated from about that many, taken by a hash of the row's
    value and its count among equal ones, which is a feature of the estimate and doesn't depend on the files' layout."""
    counted = df.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count("*").alias("c")).filter("x IS NOT NULL")
    k = F.struct(*keys)
    sizes = counted.groupBy(*keys).agg(F.sum("c").alias("_n")).select(k.alias("_k"), "_n")
    # Of a value that stands c times in a group of n, c * most / n are taken, the fraction by a hash.
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n")) * F.col("c")
    taken = F.floor(share) + ((F.pmod(F.xxhash64("x"), F.lit(1 << 30)) / float(1 << 30)) < share - F.floor(share)).cast("long")
    rows = counted.join(F.broadcast(sizes), k.eqNullSafe(F.col("_k"))).withColumn("w", taken).filter("w > 0").select(*keys, "x", "w")
    moments = rows.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s1"), F.min("x").alias("base"))
    spread = rows.join(F.broadcast(moments.select(k.alias("_k"), "n", (F.col("s1") / F.col("n")).alias("mean"))), k.eqNullSafe(F.col("_k")))
    sd = spread.groupBy(*keys).agg(F.max("n").alias("n"), F.sqrt(F.sum(F.col("w") * F.pow(F.col("x") - F.col("mean"), 2)) / (F.max("n") - 1)).alias("sd")).filter("n > 1").select(k.alias("_k"), "n", "sd")
    iqr = exact_percentiles(rows, keys, "x", [0.25, 0.75], "w").select(k.alias("_i"), ((F.col("q1") - F.col("q0")) / 1.34).alias("iqr"))
    least = F.least("sd", "iqr")
    width = sd.join(iqr, F.col("_k").eqNullSafe(F.col("_i"))).withColumn("s", F.when(least > 0, least).otherwise(F.col("sd"))).filter("s > 0").select("_k", "n", (0.9 * F.col("s") * F.pow("n", F.lit(-0.2))).alias("h"))
    joined = rows.join(F.broadcast(width), k.eqNullSafe(F.col("_k")))
    if isinstance(grid, list):
        joined = joined.withColumn("g", F.explode(F.array(*map(F.lit, grid))))
    else:
        joined = joined.join(F.broadcast(grid), [c for c in grid.columns if c != "g"])
    z = (F.col("g") - F.col("x")) / F.col("h")
    return joined.groupBy(*keys, "g").agg((F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.first(F.col("n") * F.col("h")) / (2 * 3.141592653589793) ** 0.5).alias("density"))


def index_percentile(values: Column, q: float) -> Column:
    """The value at floor(n q), at most the last, of a sorted array: picked, not interpolated."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * q).cast("int") + 1))
