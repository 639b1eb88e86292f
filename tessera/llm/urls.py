"""Operator 4: URL filters by rules, then by a ratio of character language models.

Rules judge the URLs they fit. Those verdicts are the labels from which two variable-order Markov models are made, one
of accepted and one of rejected URLs: Witten-Bell smoothing mixes each order's estimate with the next lower one, down
to the uniform one, and skips orders whose context was never seen. A URL without a rule is blocked if the rejected
model's log-likelihood, less the accepted model's and divided by the length, lies above a threshold. The threshold is
the one with the least balanced error on labelled URLs that the models used for it haven't seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, settle, table

#: (host, path, verdict). A rule fits its host and all subdomains, where the URL's path starts with the rule's.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Rules are an expression of the plan; more than this many aren't taken.
MOST_RULES = 1_000
#: Highest order of the models: symbols of context.
ORDER = 3
#: All symbols: letters, 0 for any digit, four signs, ^ before the start, $ for the end and _ for anything else. So
#: there are at most 33 ** (ORDER + 1), about a million, grams, whatever the input.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-^$_"
#: One in so many labelled URLs sets the threshold and is learned from only after that.
FOLDS = 5
#: Scores are compared in steps of 1 / STEP, within this range.
STEP, RANGE = 200, 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where url is null or has no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    found = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(found, pattern, 1)), F.regexp_extract(found, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. Of two of the same length the first in order of
    the text wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(host: Column, path: Column) -> Column:
    """The URL in SYMBOLS, with ORDER start signs and an end sign."""
    folded = F.translate(ascii_lower(F.concat(host, path)), "123456789", "0" * 9)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(folded, r"[^a-z0./\-]", "_"), F.lit("$"))


def grams(df: DataFrame) -> DataFrame:
    """df with a row for each symbol and its context: gram, ORDER + 1 symbols."""
    return df.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("_s") - ORDER), lambda i: F.substring(F.col("_s"), i, F.lit(ORDER + 1)))))


def log_ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, ratio for each of the wanted grams: log probability of the last symbol by the rejected model less that by
    the accepted one. counts: gram, label (block or allow), n. All tables here are bounded by the number of grams."""
    out = wanted.select("gram").distinct()
    for label in ("block", "allow"):
        out = out.withColumn(f"p_{label}", F.lit(1.0 / len(SYMBOLS)))
    for order in range(ORDER + 1):
        context, symbol = F.substring("gram", ORDER + 1 - order, order), F.substring("gram", ORDER + 1, 1)
        seen = counts.groupBy("label", context.alias("context"), symbol.alias("symbol")).agg(F.sum("n").alias("n"))
        by_gram = seen.groupBy("context", "symbol").agg(*(F.sum(F.when(F.col("label") == x, F.col("n"))).alias(f"n_{x}") for x in ("block", "allow")))
        by_context = seen.groupBy("context").agg(*(f(F.when(F.col("label") == x, F.col("n"))).alias(f"{k}_{x}") for x in ("block", "allow") for k, f in (("all", F.sum), ("kinds", F.count))))
        out = out.withColumns({"context": context, "symbol": symbol}).join(by_gram, ["context", "symbol"], "left").join(by_context, "context", "left")
        for x in ("block", "allow"):
            n, whole, kinds = (F.coalesce(F.col(f"{k}_{x}"), F.lit(0)) for k in ("n", "all", "kinds"))
            out = out.withColumn(f"p_{x}", F.when(whole > 0, (n + kinds * F.col(f"p_{x}")) / (whole + kinds)).otherwise(F.col(f"p_{x}")))
        out = out.select("gram", "p_block", "p_allow")
    # Whole millionths: their sums don't depend on an order.
    return settle(out.select("gram", F.round((F.log("p_block") - F.log("p_allow")) * 1e6).cast("long").alias("ratio")))


def score(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """rows (with _row and _s) with score: the summed ratio of its symbols by their number, in nats."""
    keep = [c for c in rows.columns if c != "_s"]
    found = grams(rows).join(F.broadcast(ratios), "gram")
    return found.groupBy(*keep).agg((F.sum("ratio") / F.count("*") / 1e6).alias("score"))


def threshold(scored: DataFrame) -> float:
    """From label and score: the least balanced error, nearest to 0 of equals; 0 where a label is missing. One row for
    each step of the range, by label, is all that is compared."""
    step = F.round(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("score"))) * STEP).cast("int")
    steps = scored.groupBy(step.alias("step")).agg(*(F.sum((F.col("label") == x).cast("long")).alias(x) for x in ("block", "allow")))
    up_to, whole = Window.orderBy("step"), Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    error = F.sum("block").over(up_to) / F.sum("block").over(whole) + 1 - F.sum("allow").over(up_to) / F.sum("allow").over(whole)
    both = F.when((F.sum("block").over(whole) > 0) & (F.sum("allow").over(whole) > 0), error)
    best = steps.select("step", both.alias("error"), F.lead("step").over(up_to).alias("after")).filter(F.col("error").isNotNull()).orderBy("error", F.abs(F.col("step")), "step").first()
    if best is None:
        return 0.0
    return (best["step"] + (best["after"] if best["after"] is not None else best["step"])) / 2 / STEP + 1e-9


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides); a row for each row of pages.

    URLs that are null or have no `://` have empty host and path. Without accepted or rejected URLs to learn from, all
    scores are 0 or as one model's against the uniform one, and the threshold is 0. Repeated rows are judged alike. URLs of
    any length are judged whole. Of rules of the same length the first in order of the text wins, of thresholds of the same
    error the nearest to zero. An empty table gives an empty one. Other columns of pages, whatever their names, play no part.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = settle(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("label"), symbols(F.col("host"), F.col("path")).alias("_s")))
    fold = F.pmod(F.xxhash64("host", "path"), F.lit(FOLDS)) == 0  # the same URL never is on both sides
    labelled = rows.filter(F.col("label").isNotNull())
    counts = settle(grams(labelled.select("label", "_s", fold.alias("held"))).groupBy("gram", "label", "held").agg(F.count("*").alias("n")))
    wanted = settle(grams(rows.select("_s")).groupBy("gram").agg(F.count("*").alias("n")))
    first = log_ratios(counts.filter(~F.col("held")), wanted)
    cut = threshold(score(labelled.filter(fold).select("_row", "label", "_s"), first))
    ratios = log_ratios(counts, wanted)
    free = rows.filter(F.col("label").isNull())
    judged = score(free.select("_row", "_id", "host", "path", "_s"), ratios).withColumn("verdict", F.when(F.col("score") > cut, "block").otherwise("allow"))
    ruled = labelled.select("_id", "host", "path", "rule", F.col("label").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.unionByName(judged.select("_id", "host", "path", F.lit(None).cast("string").alias("rule"), "verdict", "score")).withColumnRenamed("_id", id_col)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
