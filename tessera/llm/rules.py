"""Operator 2: quality rules, then robust multivariate outliers.

Fixed rules on a document's statistics come first. What passes is held, within its language and source, against a
minimum-covariance-determinant estimate of centre and scatter of transformed statistics (Rousseeuw and Van Driessen 1999):
from several starts, concentration steps take the share of documents nearest to the current estimate and estimate anew
from them; after FIRST steps the start of the lowest determinant goes on until no group's determinant falls. The scatter
of that share is made consistent with a normal distribution's, documents within its CORE quantile give the reweighted
estimate, and a document beyond the CUT quantile of the squared Mahalanobis distance is rejected.

There is no least size of a group: all documents, each language's and each group's have an estimate, a language's is drawn
towards that of all and a group's towards its language's, with the weight of PRIOR documents, which decides in small groups
and fades in large ones. Each statistic's variance is at least its floor in DIMENSIONS, so that a group in which nearly all
documents agree doesn't reject the first that differs a little.

All of it is DataFrame code. A step reads a narrow table of statistics, sums moments by group, and picks the nearest
share from a histogram of distances by group. What meets in one task for a group are the histogram's bins, a few thousand
at most however many documents it has, so no group meets in one task, and every run decides alike.
"""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, n_words, numbered, renamed, settle, table, unsettle, without

#: Names of the transformed statistics, the dimensions of the estimate, and what each one's variance never falls below.
DIMENSIONS = {"x_words": 0.25, "x_length": 0.005, "x_symbols": 0.001, "x_lines": 0.01, "x_repeats": 0.01}
#: Share of a group that the estimate is made from.
SHARE = 0.75
#: Concentration steps from each start, and in all at most: the determinant never rises by a step, and a few suffice.
FIRST, STEPS = 2, 20
#: Weight, in documents, of the estimate of a group's language, and of all documents in a language's.
PRIOR = 100
#: Quantiles of the squared distance within which documents give the reweighted estimate, and beyond which they go. The
#: statistics have longer tails than a normal distribution, and a good document lost costs more than a bad one kept.
CORE, CUT = 0.975, 0.9999999
#: Estimates are broadcast if they are of that many groups at most: a few hundred bytes each.
SMALL = 2_000
#: Bins of a distance's logarithm, of a width of 1 / BINS.
BINS = 64


def chi_square(x: float, dims: int) -> float:
    """Distribution function of chi-square: the lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, h = dims / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= h / k
        total += term
    return min(1.0, total * exp(a * log(h) - h - lgamma(a)))


def quantile(share: float, dims: int) -> float:
    """The squared distance within which a share of a normal distribution lies."""
    low, high = 0.0, 1_000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < share else (low, mid)
    return high


def consistency(share: float, dims: int) -> float:
    """What makes the scatter of the nearest share of a normal distribution that of all of it (Croux and Haesbroeck 1999)."""
    return share / chi_square(quantile(share, dims), dims + 2)


def base_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a whole text; all 0 for null."""
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return {
        "n_words": n_words(text),
        "word_chars": count(F.length(F.translate(text, SPACES, ""))),
        "n_symbols": count(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_lines": count(F.size(lines)),
        "n_dup_lines": count(F.size(lines) - F.size(F.array_distinct(lines))),
    }


def window_hashes(words: Column, width: int = 5) -> Column:
    """xxhash64 of each run of `width` words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(width))))


def with_repeats(df: DataFrame, windows: str, name: str, width: int = 5) -> DataFrame:
    """df with the number of words that lie in a window found twice or more, from an array column of windows' hashes.

    Repeated windows start at positions p1 < p2 < ..., and each adds the words that the one before didn't reach. Only
    texts with a repeated window are sorted. Arrays that lambdas look into are columns, so they are made once a row.
    """
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    out = df.withColumn("_places", F.when(some, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.coalesce(F.get("_places", i)["h"] == F.get("_places", j)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("_places") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    starts = F.array_sort(F.transform(twice, lambda i: F.get("_places", i)["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
    added = F.aggregate(starts, zero, lambda acc, s: F.struct((acc["n"] + F.least(F.lit(width), s - acc["last"])).alias("n"), s.alias("last")))
    return out.withColumn(name, F.when(F.col("_places").isNotNull(), added["n"]).otherwise(F.lit(0).cast("long"))).drop("_places")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words instead of the text."""
    text = F.col(text_col)
    words = F.filter(F.split(text, f"[{SPACES}]+", -1), lambda w: w != "")
    out = docs.withColumns(base_statistics(text)).withColumn("_words", F.when(F.col("n_words") >= 5, words))
    out = out.withColumn("_windows", F.when(F.col("_words").isNotNull(), window_hashes(F.col("_words"))))
    return with_repeats(out, "_windows", "n_repeat_words").drop("_windows", "_words", text_col)


def transformed() -> dict[str, Column]:
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    return {
        "x_words": F.log1p(F.col("n_words")),
        "x_length": F.log((F.col("word_chars") + 1.0) / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbols": share("n_symbols", "word_chars"),
        "x_lines": share("n_dup_lines", "n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"),
    }


def _scatter(df: DataFrame, names: list[str], factor: float) -> DataFrame:
    """grp, start, s, mean, scatter (arrays, row by row) from sums: the scatter times factor, variances at least their
    floors."""
    p = len(names)
    mean = F.array(*(F.col(f"s_{i}") / F.col("s") for i in range(p)))
    cell = lambda i, j: factor * (F.col(f"s_{max(i, j)}_{min(i, j)}") / F.col("s") - F.col(f"s_{i}") / F.col("s") * F.col(f"s_{j}") / F.col("s"))
    scatter = F.array(*(F.greatest(cell(i, j), F.lit(DIMENSIONS[names[i]])) if i == j else cell(i, j) for i in range(p) for j in range(p)))
    return df.select(*(c for c in df.columns if c in ("grp", "start")), "s", mean.alias("mean"), scatter.alias("scatter"))


def _inverted(df: DataFrame, p: int) -> DataFrame:
    """df with inverse and logdet of its scatter, which is inverted by sweeping each of its columns in turn."""

    def sweep(acc, k):
        at = lambda i, j: F.get(acc["a"], i * p + j)
        d = F.greatest(at(k, k), F.lit(1e-9))

        def one(v, c):
            i, j = F.floor(c / p).cast("int"), F.pmod(c, F.lit(p))
            return F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), v / d).otherwise(v - at(i, k) * at(k, j) / d)

        return F.struct(F.transform(acc["a"], one).alias("a"), (acc["l"] + F.log(d)).alias("l"))

    start = F.struct(F.col("scatter").alias("a"), F.lit(0.0).alias("l"))
    swept = df.withColumn("_swept", F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), start, sweep))
    return swept.withColumns({"inverse": F.transform("_swept.a", lambda v: -v), "logdet": F.col("_swept.l")}).drop("_swept")


def _moments(names: list[str]) -> list[Column]:
    """Sums of a start's rows. Values are rounded to whole hundred-thousandths first, as sums of whole numbers don't
    depend on their order."""
    p = len(names)
    exact = lambda c: F.sum(F.round(c * 1e5).cast("long")) / 1e5
    return [F.count("*").alias("s"), *(exact(F.col(n)).alias(f"s_{i}") for i, n in enumerate(names)), *(exact(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1))]


def _squared(names: list[str]) -> Column:
    """Squared Mahalanobis distance from mean and inverse."""
    p = len(names)
    away = [F.col(n) - F.get("mean", F.lit(i)) for i, n in enumerate(names)]
    terms = [away[i] * away[j] * F.get("inverse", F.lit(i * p + j)) * (1 if i == j else 2) for i in range(p) for j in range(i + 1)]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms))


def _quantile(df: DataFrame, keys: list[str], value: str, share: float, width: float) -> DataFrame:
    """keys, edge: the least bin of value, of the given width, up to which a group has its share of rows."""
    counts = df.groupBy(*keys, F.floor(F.col(value) / width).alias("edge")).agg(F.count("*").alias("_n"))
    up_to, whole = Window.partitionBy(*keys).orderBy("edge"), Window.partitionBy(*keys)
    reached = counts.select(*keys, "edge", (F.sum("_n").over(up_to) >= F.ceil(share * F.sum("_n").over(whole))).alias("_in"))
    return reached.filter("_in").groupBy(*keys).agg(F.min("edge").alias("edge"))


def estimates(stats: DataFrame, names: list[str], small: bool) -> DataFrame:
    """One row for each group of stats (columns grp and names): grp, s (documents of the reweighted estimate), mean,
    scatter, a settled table. small: whether what has a row or a few for each group may be broadcast."""
    hint = F.broadcast if small else (lambda df: df)
    p = len(names)

    def concentrated(current: DataFrame, keys: list[str]) -> DataFrame:
        """The estimate from the nearest share of rows (grp, names, d)."""
        logged = current.withColumn("_log", F.log(F.col("d") + 1e-6))
        edges = _quantile(logged, keys, "_log", SHARE, 1 / BINS)
        nearest = logged.join(hint(edges), keys).filter(F.floor(F.col("_log") / (1 / BINS)) <= F.col("edge"))
        return _inverted(_scatter(nearest.groupBy(*keys).agg(*_moments(names)), names, consistency(SHARE, p)), p)

    def away(fitted: DataFrame, *keys: str) -> DataFrame:
        return stats.join(hint(fitted.select("grp", *keys, "mean", "inverse")), "grp").select("grp", *keys, *names, _squared(names).alias("d"))

    # Medians and median deviations of each dimension, for the starts.
    longer = stats.select("grp", F.posexplode(F.array(*names)).alias("dim", "x"))
    keys = ["grp", "dim"]
    middle = settle(_quantile(longer, keys, "x", 0.5, 1e-3).select("grp", "dim", (F.col("edge") * 1e-3).alias("c")))
    off = longer.join(hint(middle), keys).withColumn("x", F.abs(F.col("x") - F.col("c")))
    spread = _quantile(off, keys, "x", 0.5, 1e-3).select("grp", "dim", (F.col("edge") * 1e-3 * 1.4826).alias("v"))
    wide = settle(middle.join(spread, keys).groupBy("grp").agg(*(F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}_{i}") for i in range(p) for c in "cv")))
    # Three starts: rows nearest to the medians by a sum of squares, a sum, and a maximum.
    scaled = [F.abs(F.col(n) - F.col(f"c_{i}")) / (F.col(f"v_{i}") + F.lit(DIMENSIONS[n] ** 0.5)) for i, n in enumerate(names)]
    starts = F.array(reduce(lambda a, b: a + b, (v * v for v in scaled)), reduce(lambda a, b: a + b, scaled), F.greatest(*scaled))
    fitted = concentrated(stats.join(hint(wide), "grp").select("grp", *names, F.posexplode(starts).alias("start", "d")), ["grp", "start"])
    for _ in range(FIRST - 1):
        old = settle(fitted)
        fitted = concentrated(away(old, "start"), ["grp", "start"])
    ranked = Window.partitionBy("grp").orderBy("logdet", "start")  # three rows a group
    own = ("s", "mean", "scatter", "inverse", "logdet")
    best = settle(fitted.withColumn("_place", F.row_number().over(ranked)).filter("_place = 1").select("grp", *own))
    unsettle(middle, wide, old)
    for _ in range(STEPS - FIRST):
        # Bins make a step's share a little larger than SHARE, so what isn't a fall isn't taken.
        new = concentrated(away(best), ["grp"]).select("grp", F.struct(*own).alias("new"))
        both = best.select("grp", F.struct(*own).alias("old")).join(hint(new), "grp", "left")
        falls = F.coalesce(F.col("new.logdet") < F.col("old.logdet") - 1e-3, F.lit(False))
        old, best = best, settle(both.select("grp", falls.alias("fell"), F.when(falls, F.col("new")).otherwise(F.col("old")).alias("e")).select("grp", "fell", "e.*"))
        unsettle(old)
        if best.filter("fell").isEmpty():
            break
    inner = away(best).filter(F.col("d") <= quantile(CORE, p))
    final = _scatter(inner.groupBy("grp").agg(*_moments(names)), names, consistency(CORE, p)).select("grp", F.struct("s", "mean", "scatter").alias("new"))
    # A group without a document within reach of its own estimate keeps that.
    out = settle(best.select("grp", F.struct("s", "mean", "scatter").alias("old")).join(hint(final), "grp", "left").select("grp", F.coalesce("new", "old").alias("e")).select("grp", "e.*"))
    unsettle(best)
    return out


def drawn(found: DataFrame, above: DataFrame, small: bool) -> DataFrame:
    """found (grp, s, mean, scatter, _above) with each estimate drawn towards that of its _above among above."""
    hint = F.broadcast if small else (lambda df: df)
    to = above.select(F.col("grp").alias("_above"), F.col("mean").alias("_mean"), F.col("scatter").alias("_scatter"))
    own = F.col("s") / (F.col("s") + PRIOR)
    mixed = lambda a, b: F.zip_with(a, b, lambda x, y: x * F.col("_w") + y * (1 - F.col("_w")))
    return found.join(hint(to), "_above").withColumn("_w", own).select("grp", "s", mixed("mean", "_mean").alias("mean"), mixed("scatter", "_scatter").alias("scatter"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where the base rules fail), kept; a row for each row.

    A null text has no words and fails the base rules. Null languages and sources are values like others. Texts of any
    length are read whole. Repeated rows are judged alike and count as often as they stand; of documents at equal distances
    all or none are in a nearest share. An empty table gives an empty one. Other columns of docs, whatever their names,
    play no part.
    """
    taken = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_text"))
    stats = statistics(taken, "_text").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    stats = settle(stats.withColumns(transformed()))
    return _verdicts(stats).select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    rows = numbered(docs)
    at = lambda c: renamed(rows, c)
    return without(rows, settle(judge(rows, "_row", at(text_col), at(lang_col), at(source_col)).filter(~F.col("kept")).select("_row")))


def _verdicts(stats: DataFrame) -> DataFrame:
    names = list(DIMENSIONS)
    # Names of groups are hashes of JSON, in which null is a value of its own.
    name = lambda *c: F.md5(F.to_json(F.struct(*c), {"ignoreNullFields": "false"}))
    levels = F.explode(F.array(F.lit("all"), F.col("language"), F.col("pair")))
    passed = stats.filter(~F.col("base_failed")).select(name("_lang", "_source").alias("pair"), name("_lang").alias("language"), *names)
    each = settle(passed.select(levels.alias("grp"), "pair", "language", *names))
    pairs = settle(each.filter("grp = pair").select("pair", "language").distinct())
    small = pairs.count() <= SMALL
    hint = F.broadcast if small else (lambda df: df)
    found = estimates(each.select("grp", *names), names, small)
    whole = found.filter("grp = 'all'")
    languages = drawn(found.join(hint(pairs.select(F.col("language").alias("grp")).distinct()), "grp").withColumn("_above", F.lit("all")), whole, small)
    groups = drawn(found.join(hint(pairs.select(F.col("pair").alias("grp"), F.col("language").alias("_above"))), "grp"), languages, small)
    known = settle(_inverted(groups, len(names)).select("grp", "mean", "inverse"))
    unsettle(each, pairs, found)
    kept = [c for c in stats.columns if c not in names]
    judged = stats.filter(~F.col("base_failed")).withColumn("grp", name("_lang", "_source")).join(hint(known), "grp").withColumn("distance", _squared(names))
    failed = stats.filter("base_failed").select(*kept, F.lit(None).cast("double").alias("distance"))
    return judged.select(*kept, "distance").unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= quantile(CUT, len(names))))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
