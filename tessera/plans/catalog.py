"""Queries of the library over the driver's tables, which stand in for its own: documents for programs, languages for
prompt kinds, sources for ideas, labels for outcomes, events for calls and attempts, orders for tasks.

Rates and entropies are rounded, so that two engines' sums compare.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import programs, text
from ..operators import iterations, records, selection, stats, store
from ..sources import io
from .registry import query

FLAGSHIP = "top_surprisal"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def order_key(c: Column) -> Column:
    """A shuffle that SQL can say as well."""
    return (c * 7919) % 100003


def labelled(spark, sf_dir) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id")


def words(docs: DataFrame, distinct: bool = False) -> DataFrame:
    """doc, kind, metric, value, cnt: words of each text, and its number of lines. A word has a row each time it stands, or
    once with distinct: what sums counts does so before it shuffles, so documents' words never shuffle on their own."""
    each = F.split("text", " ", -1)
    value = F.explode(F.array_distinct(each) if distinct else each)
    name = [F.col("doc_id").alias("doc"), F.col("lang").alias("kind")]
    one = F.lit(1).cast("long").alias("cnt")
    found = docs.select(*name, F.lit("word").alias("metric"), value.alias("value"), one).filter("value <> ''")
    return found.unionByName(docs.select(*name, F.lit("lines").alias("metric"), F.size(F.split("text", "\n", -1)).cast("string").alias("value"), one))


WORDS = """features AS (
  SELECT doc, kind, 'word' AS metric, value, count(*) AS cnt FROM (SELECT doc_id AS doc, lang AS kind, unnest(string_split(text, ' ')) AS value FROM documents) WHERE value <> '' GROUP BY doc, kind, value
  UNION ALL SELECT doc_id, lang, 'lines', len(string_split(text, chr(10)))::VARCHAR, 1 FROM documents)"""
LOW = "(p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)"
HIGH = LOW.replace(" - 1.96*sqrt", " + 1.96*sqrt")

# --- counts and rates ----------------------------------------------------------------------------------------------


@query("event_success_rate", f"""WITH c AS (SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS successes FROM events GROUP BY event_type), r AS (SELECT *, successes / n AS p FROM c)
SELECT event_type, n, successes, round(p, 6) AS rate, round(greatest(0, {LOW}), 6) AS ci_low, round(least(1, {HIGH}), 6) AS ci_high FROM r""")
def event_success_rate(spark, sf_dir):
    return r6(stats.success_rate(load(spark, sf_dir, "events"), ["event_type"], F.col("value") > 50), "rate", "ci_low", "ci_high")


@query("source_success_rate_unclamped", f"""WITH c AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS successes FROM documents JOIN labels USING (doc_id) GROUP BY source), r AS (SELECT *, successes / n AS p FROM c)
SELECT source, n, successes, round(p, 6) AS rate, round({LOW}, 6) AS ci_low, round({HIGH}, 6) AS ci_high FROM r""")
def source_success_rate(spark, sf_dir):
    return r6(stats.success_rate(labelled(spark, sf_dir), ["source"], F.col("quality") == 1, clamp=False), "rate", "ci_low", "ci_high")


@query("distill_stats", """SELECT lang, outcome, (grouping(lang) * 2 + grouping(outcome))::INT AS level, count(*) AS n FROM (SELECT coalesce(lang, 'unknown') AS lang, coalesce(quality::VARCHAR, 'unknown') AS outcome FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY CUBE (lang, outcome)""")
def distill_stats(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("outcome")), "doc_id", "left")
    return stats.grouping_counts(rows, "lang", "outcome")


@query("budget_pivot", """SELECT event_type, sum((user_id % 3 = 0)::INT)::BIGINT AS run0, sum((user_id % 3 = 1)::INT)::BIGINT AS run1, sum((user_id % 3 = 2)::INT)::BIGINT AS run2, count(*) AS total FROM events GROUP BY event_type""")
def budget_pivot(spark, sf_dir):
    runs = load(spark, sf_dir, "events").select("event_type", F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run"))
    return stats.pivot_counts(runs, "event_type", "run", ["run0", "run1", "run2"])


@query("status_shares", """WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share FROM c""")
def status_shares(spark, sf_dir):
    return r6(stats.shares(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), "share")


@query("type_success_rate", """SELECT o_orderpriority, round(sum((o_orderstatus = 'F')::INT) / count(*), 6) AS rate FROM orders GROUP BY 1""")
def type_success_rate(spark, sf_dir):
    return r6(store.done_rate(load(spark, sf_dir, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F"), "rate")


@query("yield_per_attempt", """SELECT source, round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*), 6) AS yield_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def yield_per_attempt(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.round(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)) / F.count("*"), 6).alias("yield_rate"))


@query("outcome_counts", "SELECT event_type, user_id % 4 AS status, count(*) AS n FROM events GROUP BY ALL")
def outcome_counts(spark, sf_dir):
    return store.outcome_counts(load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("status")), "event_type", "status")


@query("current_tasks", """SELECT event_type, state, count(*) AS n FROM (SELECT user_id, event_type, (event_id % 3)::BIGINT AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY ALL""")
def current_tasks(spark, sf_dir):
    log = load(spark, sf_dir, "events").withColumn("state", F.col("event_id") % 3)
    return store.current_tasks(log, "user_id", "event_type", "state", ["ts", "event_id"])


# --- longest of a group --------------------------------------------------------------------------------------------

_SIZES = {
    "lines": "CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END",
    "content": "length(text)", "text": "length(text)",
    "loc": "len(list_filter(string_split(text, chr(10)), lambda x: length(trim(translate(x, chr(9) || chr(13) || chr(11) || chr(12), ''))) > 0))",
}


def _longest(rule: str):
    key = "coalesce(source, 'own:' || doc_id)" if selection.RULES[rule][1] else "source"

    @query(f"longest_by_{rule}", f"SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {_SIZES[rule]} DESC, doc_id) AS k FROM documents) WHERE k = 1")
    def longest(spark, sf_dir):
        return selection.longest_per_group(load(spark, sf_dir, "documents"), rule, "source", "doc_id", "text").select("doc_id", "source", "n_chars")


for _rule in selection.RULES:
    _longest(_rule)


@query("codebase_stats", """WITH best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents), s AS (SELECT lang, text, k FROM best)
SELECT lang, count(*) AS programs, sum((k = 1)::INT)::BIGINT AS longest, sum(len(string_split(text, chr(10))))::BIGINT AS total_lines, coalesce(sum(len(string_split(text, chr(10)))) FILTER (k = 1), 0)::BIGINT AS longest_lines, sum(len(regexp_extract_all(text, '(?m)^the ')))::BIGINT AS keyword_lines FROM s GROUP BY lang""")
def codebase_stats(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    best = selection.longest_per_group(docs, "text", "source", "doc_id", "text").select("doc_id", F.lit(1).alias("best"))
    lines = F.size(F.split("text", "\n", -1))
    return docs.join(best, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("programs"), F.sum(F.coalesce("best", F.lit(0))).alias("longest"), F.sum(lines).alias("total_lines"),
        F.sum(F.when(F.col("best") == 1, lines).otherwise(0)).alias("longest_lines"), F.sum(F.regexp_count("text", F.lit("(?m)^the "))).alias("keyword_lines"),
    )


@query("dataset_stats", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents)
SELECT (SELECT count(DISTINCT source) FROM documents) AS ideas, (SELECT count(*) FROM documents) AS variations, (SELECT count(DISTINCT l) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM b WHERE k = 1) WHERE l <> '') AS distinct_lines,
(SELECT sum(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '//'))))::BIGINT FROM b WHERE k = 1) AS code_lines,
(SELECT sum(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^assert\b'))))::BIGINT FROM b WHERE k = 1) AS asserts""")
def dataset_stats(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    best = selection.longest_per_group(docs, "text", "source", "doc_id", "text")
    lines = best.select(F.explode(F.split("text", "\n", -1)).alias("l")).filter("l <> ''").agg(F.countDistinct("l").alias("distinct_lines"))
    counts = stats.spec_counts(F.col("text"))
    specs = best.agg(F.sum(counts["code_lines"]).alias("code_lines"), F.sum(counts["asserts"]).alias("asserts"))
    return docs.agg(F.countDistinct("source").alias("ideas"), F.count("*").alias("variations")).join(F.broadcast(lines)).join(F.broadcast(specs))  # one row each


@query("hub_stats", """SELECT lang, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers, sum(len(regexp_extract_all(text, '[.]')))::BIGINT AS stops FROM documents GROUP BY lang""")
def hub_stats(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit("[0-9]+"))).alias("numbers"), F.sum(F.regexp_count("text", F.lit("[.]"))).alias("stops"))


# --- features: entropy, novelty, surprisal, rarefaction ------------------------------------------------------------

_H = "round(greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)), 6)"


@query("feature_entropy", f"""WITH {WORDS}, p AS (SELECT kind, metric, value, sum(cnt) AS c FROM features GROUP BY ALL) SELECT kind, metric, {_H} AS entropy, count(*) AS unique_values, sum(c)::BIGINT AS total FROM p GROUP BY kind, metric""")
def feature_entropy(spark, sf_dir):
    return r6(stats.entropy_bits(words(load(spark, sf_dir, "documents")), ["kind", "metric"]), "entropy")


@query("novelty", f"""WITH {WORDS}, f AS (SELECT metric, value, min((doc * 7919) % 100003) AS first, sum(cnt) AS c FROM features GROUP BY ALL)
SELECT metric, count(*) AS unique_values, sum(c)::BIGINT AS total, round(count(*) / sum(c), 6) AS p_new, round(count(DISTINCT first) / (SELECT count(DISTINCT (doc * 7919) % 100003) FROM features), 6) AS p_any_new FROM f GROUP BY metric""")
def novelty(spark, sf_dir):
    features = words(load(spark, sf_dir, "documents")).withColumn("ord", order_key(F.col("doc")))
    return r6(stats.novelty(features), "p_new", "p_any_new")


_S = f"""{WORDS}, p AS (SELECT kind, metric, value, sum(cnt) AS c FROM features GROUP BY ALL), t AS (SELECT *, log2(sum(c) OVER (PARTITION BY kind, metric) / c) AS s FROM p),
s AS (SELECT doc, kind, metric, max(s) AS surprisal FROM features JOIN t USING (kind, metric, value) GROUP BY ALL)"""


@query("max_surprisal", f"WITH {_S} SELECT doc, kind, metric, round(surprisal, 6) AS surprisal FROM s")
def max_surprisal(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return r6(stats.max_surprisal(words(docs), present=words(docs, distinct=True)), "surprisal")


@query("top_surprisal", f"""WITH {_S}, r AS (SELECT doc, kind, row_number() OVER (PARTITION BY kind, metric ORDER BY round(surprisal, 6) DESC, doc) AS k FROM s), b AS (SELECT doc, kind, min(k) AS best_rank FROM r GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY best_rank, doc) AS place, greatest(1, ceil(0.33 * count(*) OVER (PARTITION BY kind))) AS kept FROM b)
SELECT doc, kind, best_rank::INT AS best_rank FROM q WHERE place <= kept""")
def top_surprisal(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return selection.top_surprisal(words(docs), docs.select(F.col("doc_id").alias("doc"), F.col("lang").alias("kind")), 0.33, present=words(docs, distinct=True))


@query("surprisal_against", f"""WITH {WORDS}, bench AS (SELECT 'word' AS metric, value, count(*) AS c FROM (SELECT unnest(string_split(text, ' ')) AS value FROM benchmark) WHERE value <> '' GROUP BY value), t AS (SELECT metric, value, log2(sum(c) OVER () / c) AS s FROM bench)
SELECT doc, metric, CASE WHEN isinf(max(coalesce(s, 'inf'::DOUBLE))) THEN -1 ELSE round(max(coalesce(s, 'inf'::DOUBLE)), 6) END AS surprisal FROM (SELECT * FROM features WHERE metric = 'word') LEFT JOIN t USING (metric, value) GROUP BY ALL""")
def surprisal_against(spark, sf_dir):
    bench = load(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("value")).filter("value <> ''").select(F.lit("word").alias("metric"), "value", F.lit(1).alias("cnt"))
    out = stats.surprisal_against(words(load(spark, sf_dir, "documents"), distinct=True).filter("metric = 'word'"), bench)
    return out.withColumn("surprisal", F.when(F.col("surprisal") == float("inf"), -1.0).otherwise(F.round("surprisal", 6)))


@query("rarefaction", f"""WITH {WORDS}, o AS (SELECT doc, row_number() OVER (ORDER BY (doc * 7919) % 100003, doc) AS ord FROM (SELECT DISTINCT doc FROM features)),
steps AS (SELECT DISTINCT floor(pow(1.5, k))::BIGINT AS n FROM range(0, 80) t(k) WHERE floor(pow(1.5, k)) >= 10 AND pow(1.5, k) < (SELECT count(*) FROM o) UNION SELECT count(*) FROM o),
p AS (SELECT n, metric, value, sum(cnt) AS c FROM features JOIN o USING (doc) JOIN steps ON ord <= n GROUP BY ALL) SELECT n, metric, {_H} AS entropy, count(*) AS unique_values FROM p GROUP BY n, metric""")
def rarefaction(spark, sf_dir):
    return r6(selection.rarefaction_curve(words(load(spark, sf_dir, "documents")), order_key(F.col("doc"))), "entropy")


@query("shared_metrics", f"""WITH {WORDS} SELECT metric, sum(cnt)::BIGINT AS n FROM features WHERE metric IN ('lines') GROUP BY metric""")
def shared_metrics(spark, sf_dir):
    kept = selection.supported_metrics(words(load(spark, sf_dir, "documents")), ["lines", "loops"], ["word", "lines"])
    return kept.groupBy("metric").agg(F.sum("cnt").alias("n"))


@query("diversity_table", """WITH per AS (SELECT lang, doc_id, len(string_split(text, chr(10)))::DOUBLE AS m FROM documents) SELECT lang, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.9), 6) AS p90, round(quantile_cont(m, 0.95), 6) AS p95 FROM per GROUP BY lang""")
def diversity_table(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("doc"), F.size(F.split("text", "\n", -1)).alias("x"), F.lit(1).alias("cnt"))
    return r6(stats.two_level(rows, ["lang"]), "mean", "p90", "p95")


@query("program_complexity", """WITH cut AS (SELECT quantile_cont(length(text), 0.25) AS low FROM benchmark) SELECT lang, count(*) AS n, sum((length(text) > low)::INT)::BIGINT AS above FROM documents, cut GROUP BY lang""")
def program_complexity(spark, sf_dir):
    cut = load(spark, sf_dir, "benchmark").agg(F.percentile(F.length("text"), 0.25).alias("low"))
    return load(spark, sf_dir, "documents").select("lang", F.length("text").alias("x")).join(F.broadcast(cut)).groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("x") > F.col("low")).cast("long")).alias("above"))


@query("top_values", f"""WITH {WORDS} SELECT value, coalesce(sum(cnt) FILTER (kind = 'en'), 0)::BIGINT AS en, coalesce(sum(cnt) FILTER (kind = 'de'), 0)::BIGINT AS de, sum(cnt)::BIGINT AS total FROM features WHERE metric = 'word' GROUP BY value ORDER BY total DESC, value LIMIT 25""")
def top_values(spark, sf_dir):
    return stats.top_values(words(load(spark, sf_dir, "documents")).filter("metric = 'word'"), 25, ["en", "de"], "kind")


@query("top_shares", f"""WITH {WORDS}, p AS (SELECT kind, metric, value, sum(cnt)::BIGINT AS c FROM features GROUP BY ALL), q AS (SELECT *, round(c / sum(c) OVER (PARTITION BY kind, metric), 6) AS share, row_number() OVER (PARTITION BY kind, metric ORDER BY c DESC, value)::INT AS place FROM p) SELECT * FROM q WHERE place <= 10""")
def top_shares(spark, sf_dir):
    return r6(stats.top_shares(words(load(spark, sf_dir, "documents")), ["kind", "metric"]), "share")


@query("features_only_in", f"""WITH {WORDS} SELECT DISTINCT value FROM features WHERE metric = 'word' AND kind = 'de' EXCEPT SELECT value FROM features WHERE metric = 'word' AND kind = 'en'""")
def features_only_in(spark, sf_dir):
    features = words(load(spark, sf_dir, "documents")).filter("metric = 'word'")
    return features.filter("kind = 'de'").select("value").subtract(features.filter("kind = 'en'").select("value"))


# --- attempts ------------------------------------------------------------------------------------------------------

_RESULTS = "results AS (SELECT event_type AS model, user_id, value > 50 AS success, (event_id % 7 + 1)::INT AS num_attempts FROM events)"


def results(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "user_id", (F.col("value") > 50).alias("success"), (F.col("event_id") % 7 + 1).cast("int").alias("num_attempts"))


@query("pass_at_k", f"""WITH {_RESULTS} SELECT model, k, round(avg((success AND num_attempts <= k)::INT), 6) AS pass_at_k FROM results, (SELECT unnest([1, 2, 4, 8])::INT AS k) GROUP BY model, k""")
def pass_at_k(spark, sf_dir):
    return r6(stats.pass_at_k(results(spark, sf_dir), ["model"], [1, 2, 4, 8]), "pass_at_k")


@query("pass_at_k_facets", f"""WITH {_RESULTS} SELECT model, k, round(avg((success AND num_attempts <= k)::INT), 6) AS pass_at_k FROM results, (SELECT unnest([1, 2, 4, 8])::INT AS k) GROUP BY model, k HAVING k <= max(num_attempts)""")
def pass_at_k_facets(spark, sf_dir):
    return r6(stats.pass_at_k(results(spark, sf_dir), ["model"], [1, 2, 4, 8], drop_above_max=True), "pass_at_k")


@query("cumulative_success", f"""WITH {_RESULTS} SELECT model, attempt::INT AS attempt, sum((success AND num_attempts <= attempt)::INT)::BIGINT AS solved FROM results, (SELECT unnest(range(1, 8)) AS attempt) GROUP BY ALL""")
def cumulative_success(spark, sf_dir):
    return stats.cumulative_success(results(spark, sf_dir), "model", 7)


@query("method_distribution", f"""WITH {_RESULTS}, c AS (SELECT model, num_attempts, count(*) AS n_exact FROM results GROUP BY ALL) SELECT *, sum(n_exact) OVER (PARTITION BY model ORDER BY num_attempts DESC)::BIGINT AS n_at_least FROM c""")
def method_distribution(spark, sf_dir):
    return stats.distribution(results(spark, sf_dir), "model", "num_attempts")


@query("solved_by_one", f"""WITH {_RESULTS}, s AS (SELECT DISTINCT model, user_id FROM results WHERE success) SELECT user_id, min(model) AS model FROM s GROUP BY user_id HAVING count(*) = 1""")
def solved_by_one(spark, sf_dir):
    solved = results(spark, sf_dir).filter("success").select("model", "user_id").distinct()
    return solved.groupBy("user_id").agg(F.min("model").alias("model"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("models_side_by_side", f"""WITH {_RESULTS}, s AS (SELECT model, user_id, max(success::INT) AS ok FROM results GROUP BY ALL) SELECT user_id, string_agg(model || '=' || ok, '|' ORDER BY model) AS solved FROM s GROUP BY user_id""")
def models_side_by_side(spark, sf_dir):
    best = results(spark, sf_dir).groupBy("model", "user_id").agg(F.max(F.col("success").cast("int")).alias("ok"))
    each = F.array_sort(F.collect_list(F.struct("model", "ok")))  # a row for each model
    return best.groupBy("user_id").agg(each.alias("m")).select("user_id", F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["model"], x["ok"].cast("string"))), "|").alias("solved"))


@query("repair_classes", """WITH t AS (SELECT event_type, event_id % 3 AS repairs, CASE event_id % 4 WHEN 0 THEN 'DONE' ELSE 'FAILED' END AS status, CASE event_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['FAIL'] ELSE ['FAIL', 'SUCCESS'] END AS v FROM events)
SELECT event_type, sum((repairs = 0 AND status = 'DONE')::INT)::BIGINT AS no_repair, sum((len(v) > 0 AND v[-1] = 'SUCCESS')::INT)::BIGINT AS repaired, sum((len(v) > 0 AND v[-1] <> 'SUCCESS')::INT)::BIGINT AS all_failed FROM t GROUP BY event_type""")
def repair_classes(spark, sf_dir):
    k = F.col("event_id")
    tried = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("FAIL"))).otherwise(F.array(F.lit("FAIL"), F.lit("SUCCESS")))
    rows = load(spark, sf_dir, "events").select("event_type", (k % 3).alias("repair_attempts"), F.when(k % 4 == 0, "DONE").otherwise("FAILED").alias("work_status"), tried.alias("verification"))
    return stats.repair_classes(rows, ["event_type"])


# --- store ---------------------------------------------------------------------------------------------------------


_UP = """WITH RECURSIVE up AS (SELECT doc_id AS node, doc_id // 2 AS ancestor, 1 AS distance, 1 + doc_id % 5 AS factor FROM documents WHERE doc_id > 0 UNION ALL SELECT node, ancestor // 2, distance + 1, factor FROM up WHERE ancestor > 0)"""


@query("lineage", _UP + " SELECT node, ancestor, min(distance)::INT AS distance FROM up GROUP BY node, ancestor")
def lineage(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id")
    return store.lineage(docs.filter("doc_id > 0").select(F.col("doc_id").alias("node"), F.floor(F.col("doc_id") / 2).cast("long").alias("parent")))


_TASKS = """tasks AS (SELECT o_orderkey AS id, o_totalprice AS priority, o_custkey AS dep, o_orderstatus FROM orders), eff AS (SELECT id, priority, o_orderstatus, priority * coalesce(c_acctbal / 1000, 1) AS effective FROM tasks LEFT JOIN customer ON c_custkey = dep)"""


def tasks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("priority"), F.array("o_custkey").alias("interest_dependencies"), "o_orderstatus")
    return orders, load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), (F.col("c_acctbal") / 1000).alias("interestingness"))


@query("effective_priority", f"WITH {_TASKS} SELECT id, round(priority, 6) AS priority, round(effective, 4) AS effective FROM eff")
def effective_priority(spark, sf_dir):
    return store.effective_priority(*tasks(spark, sf_dir)).select("id", F.round("priority", 6).alias("priority"), F.round("effective", 4).alias("effective"))


@query("claim_batch", f"WITH {_TASKS} SELECT id, round(effective, 4) AS effective FROM eff WHERE o_orderstatus = 'O' ORDER BY eff.effective DESC, id LIMIT 50")
def claim_batch(spark, sf_dir):
    own, objects = tasks(spark, sf_dir)
    rated = store.effective_priority(own, objects).join(own.select("id", F.when(F.col("o_orderstatus") == "O", "NEW").otherwise("DONE").alias("work_status")), "id")
    return store.claim(rated, 50).select("id", F.round("effective", 4).alias("effective"))


@query("propagated_priority", _UP + """, f AS (SELECT ancestor AS node, max(factor * pow(0.5, distance)) AS factor FROM up GROUP BY ancestor)
SELECT doc_id AS node, round(factor, 6) AS factor, round(greatest(doc_id % 3, coalesce(factor, 0)), 6) AS priority FROM documents LEFT JOIN f ON doc_id = node""")
def propagated_priority(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    updates = docs.select(F.col("doc_id").alias("node"), (1 + F.col("doc_id") % 5).alias("factor"))
    own = docs.select(F.col("doc_id").alias("node"), (F.col("doc_id") % 3).cast("double").alias("priority"))
    return r6(store.propagate_priority(lineage(spark, sf_dir), updates, 0.5, own), "factor", "priority")


_LOG = """log AS (SELECT user_id AS id, event_id AS ord, CASE event_id % 5 WHEN 0 THEN 'DOING' WHEN 1 THEN 'ATTEMPTED' WHEN 2 THEN 'DONE' WHEN 3 THEN 'FAILED' END AS status, CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS factor FROM events)"""


def task_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events, k = load(spark, sf_dir, "events"), F.col("event_id")
    status = F.when(k % 5 == 0, "DOING").when(k % 5 == 1, "ATTEMPTED").when(k % 5 == 2, "DONE").when(k % 5 == 3, "FAILED")
    notes = F.create_map(F.concat(F.lit("k"), (k % 2).cast("string")), k.cast("string"))
    log = events.select(F.col("user_id").alias("id"), k.alias("ord"), status.alias("status"), F.when(k % 3 == 0, 0.5).when(k % 3 == 1, 1.0).otherwise(2.0).alias("factor"), notes.alias("notes"))
    tasks = events.select(F.col("user_id").alias("id")).distinct().select("id", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("type"), F.lit(1.0).alias("priority"), F.lit("NEW").alias("work_status"), F.lit(0).alias("attempts"), F.lit(None).cast("map<string,string>").alias("worker_notes"))
    return tasks, log


@query("updated_tasks", f"""WITH {_LOG} SELECT id, coalesce(arg_max(status, ord) FILTER (status IS NOT NULL), 'NEW') AS work_status, sum((status IN ('DOING', 'ATTEMPTED'))::INT)::INT AS attempts, log2(product(factor))::DOUBLE AS log_priority, max(ord)::VARCHAR AS last_note FROM log GROUP BY id""")
def updated_tasks(spark, sf_dir):
    after = store.updated_tasks(*task_log(spark, sf_dir))
    note = F.array_max(F.transform(F.map_values("worker_notes"), lambda x: x.cast("long"))).cast("string")
    return after.select("id", "work_status", "attempts", F.log2("priority").alias("log_priority"), note.alias("last_note"))


@query("attempt_outcomes", f"""WITH {_LOG} SELECT 't' || (id % 3) AS type, status, count(*) AS n FROM log WHERE status IN ('ATTEMPTED', 'DONE', 'FAILED') GROUP BY ALL""")
def attempt_outcomes(spark, sf_dir):
    return store.outcomes(*task_log(spark, sf_dir))


@query("recovered_tasks", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'ATTEMPTED' ELSE o_orderstatus END AS work_status FROM orders")
def recovered_tasks(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "DOING").otherwise(F.col("o_orderstatus")).alias("work_status"))
    return store.recovered(rows)


@query("unique_paths", """SELECT doc_id, CASE WHEN k > 0 THEN path || '-' || k ELSE path END AS path FROM (SELECT doc_id, lang || '/' || source AS path, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS k FROM documents)""")
def unique_paths(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("path"))
    return store.unique_paths(rows, "path", "doc_id")


# --- calls ---------------------------------------------------------------------------------------------------------


def calls(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("procedure"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency"), F.col("user_id").alias("client"))


@query("rolling_calls", """SELECT event_id, count(*) OVER w AS n_window, round(avg(value) OVER w, 6) AS mean_latency FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW)""")
def rolling_calls(spark, sf_dir):
    return r6(store.rolling_calls(calls(spark, sf_dir)), "mean_latency").select("event_id", "n_window", "mean_latency")


@query("window_calls", """SELECT event_type AS procedure, epoch_us(time_bucket(INTERVAL 600 SECOND, ts)) AS start_us, count(*) AS n, round(count(*) / 600, 6) AS per_second, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL""")
def window_calls(spark, sf_dir):
    out = r6(store.window_calls(calls(spark, sf_dir)), "per_second", "mean", "p50", "p95")
    return out.withColumn("start_us", F.unix_micros("start")).drop("start")


@query("last_seen", "SELECT user_id AS client, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY user_id")
def last_seen(spark, sf_dir):
    return store.last_seen(calls(spark, sf_dir)).select("client", F.unix_micros("last_seen").alias("last_us"), "n")


@query("hourly_deltas", """SELECT event_id, round(CASE WHEN h > 0 THEN d / h END, 4) AS per_hour FROM (SELECT event_id, value - lag(value) OVER w AS d, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) WINDOW w AS (PARTITION BY user_id ORDER BY ts))""")
def hourly_deltas(spark, sf_dir):
    one = load(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min(F.struct("event_id", "value")).alias("e")).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "e.*")
    return store.deltas(one, "user_id", "ts", "value").select("event_id", F.round("per_hour", 4).alias("per_hour"))


# --- selection, splits, records ------------------------------------------------------------------------------------


@query("train_val_split", """WITH p AS (SELECT source, min((doc_id * 7919) % 100003) AS o FROM documents GROUP BY source), v AS (SELECT source FROM p QUALIFY row_number() OVER (ORDER BY o, source) <= greatest(1, floor((SELECT count(*) FROM p) * 0.1))) SELECT doc_id, CASE WHEN v.source IS NULL THEN 'train' ELSE 'val' END AS split FROM documents LEFT JOIN v USING (source)""")
def train_val_split(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.split_by_program(docs, F.col("source"), 0.1, order_key(F.col("doc_id"))).select("doc_id", "split")


@query("chat_records", """WITH m AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, (len(m) - 1)::INT AS n_prompt, m[-1].t AS answer FROM m WHERE m[-1].r = 'assistant'""")
def chat_records(spark, sf_dir):
    rows = records.chat_records(load(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.size("prompt").alias("n_prompt"), F.col("completion")[0]["content"].alias("answer"))


@query("taken_ideas", """SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang = 'de')""")
def taken_ideas(spark, sf_dir):
    good = labelled(spark, sf_dir).filter("quality = 1 AND lang = 'de'").select("source").distinct()
    return load(spark, sf_dir, "documents").join(good, "source", "left_semi").select("doc_id")


@query("missing_results", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_results(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("pooled_runs", "SELECT lang, count(*) AS n FROM (SELECT lang FROM documents UNION ALL SELECT lang FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def pooled_runs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("lang").unionByName(labelled(spark, sf_dir).select("lang")).groupBy("lang").agg(F.count("*").alias("n"))


@query("iteration_metrics", f"""WITH c AS (SELECT (doc_id % 4)::BIGINT AS iteration, lang, count(*) AS n, sum(quality)::BIGINT AS successes FROM documents JOIN labels USING (doc_id) GROUP BY ALL), r AS (SELECT *, successes / n AS p FROM c) SELECT iteration, lang, n, successes, round(p, 6) AS rate, round(greatest(0, {LOW}), 6) AS ci_low, round(least(1, {HIGH}), 6) AS ci_high FROM r""")
def iteration_metrics(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("iteration", F.col("doc_id") % 4)
    return r6(stats.success_rate(rows, ["iteration", "lang"], F.col("quality") == 1), "rate", "ci_low", "ci_high")


@query("iteration_entropy", f"""WITH {WORDS}, p AS (SELECT (doc % 3)::INT AS iteration, metric, value, sum(cnt) AS c FROM features GROUP BY ALL) SELECT iteration, metric, {_H} AS entropy, count(*) AS unique_values, sum(c)::BIGINT AS total FROM p GROUP BY iteration, metric""")
def iteration_entropy(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    found = iterations.discover(["run-seed-a", "run-seed-b", "run_it1", "run_it2"], r"-seed-", r"_it(\d+)$")
    parts = {"run-seed-a": "doc_id % 6 = 0", "run-seed-b": "doc_id % 6 = 3", "run_it1": "doc_id % 3 = 1", "run_it2": "doc_id % 3 = 2"}
    return r6(iterations.entropies(iterations.collected(found, lambda path: words(docs.filter(parts[path])))), "entropy")


@query("iteration_distributions", """WITH f AS (SELECT (doc_id % 3)::INT AS iteration, 'lines' AS metric, len(string_split(text, chr(10)))::DOUBLE AS x FROM documents), e AS (SELECT round(quantile_cont(x, 0.5), 6) AS low, round(quantile_cont(x, 0.99), 6) AS high FROM f)
SELECT iteration, metric, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, any_value(low) AS low, any_value(high) AS high FROM f, e GROUP BY iteration, metric""")
def iteration_distributions(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").select((F.col("doc_id") % 3).cast("int").alias("iteration"), F.lit("lines").alias("metric"), F.size(F.split("text", "\n", -1)).cast("double").alias("x"), F.lit(1).cast("long").alias("cnt"))
    return r6(iterations.distributions(rows), "mean", "p90", "p95", "low", "high")


@query("kde", """WITH b AS (SELECT lang, length(text)::DOUBLE AS x FROM documents ), w AS (SELECT lang, count(*) AS n, 0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * pow(count(*), -0.2) AS h FROM b GROUP BY lang HAVING count(*) > 1)
SELECT lang, g, round(sum(exp(-0.5 * pow((g - x) / h, 2))) / any_value(n * h) / sqrt(2 * pi()), 9) AS density FROM b JOIN w USING (lang), (SELECT unnest([0.0, 500.0, 1000.0, 2000.0, 5000.0]) AS g) GROUP BY ALL""")
def kde(spark, sf_dir):
    out = stats.kde(load(spark, sf_dir, "documents").select("lang", F.length("text").alias("x")), ["lang"], "x", [0.0, 500.0, 1000.0, 2000.0, 5000.0])
    return out.withColumn("density", F.round("density", 9))


# --- text ----------------------------------------------------------------------------------------------------------


@query("parsed_properties", "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY event_type")
def parsed_properties(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


@query("truncated", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substring(text, 1, 97) || '...' END AS short FROM documents")
def truncated(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 100).alias("short"))


@query("stripped_lines", r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '/\*(?s:.*?)\*/', ' ', 'g'), '//[^\n]*', '', 'g'), chr(10)), lambda x: regexp_matches(x, '\S')))::INT AS n FROM documents""")
def stripped_lines(spark, sf_dir):
    cut = text.stripped(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.when(cut == "", 0).otherwise(F.size(F.split(cut, "\n", -1))).alias("n"))


@query("slugs", r"""SELECT item_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM benchmark""")
def slugs(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", text.slugify(F.col("text")).alias("slug"))


@query("examples", """SELECT 'd' || doc_id AS _path, lang AS prompt, text || chr(65533) AS response, CASE WHEN doc_id % 2 = 0 THEN 'success' END AS outcome FROM documents WHERE doc_id % 7 <> 0""")
def examples(spark, sf_dir):
    """Stored examples of all documents, in each a byte that is no UTF-8; a seventh are no JSON."""
    k, plain = F.col("doc_id"), lambda c: F.encode(c, "UTF-8")
    cut = lambda c, n: F.expr(f"substring({c}, 1, length({c}) - {n})")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("lang").alias("prompt"))).alias("head"), F.to_json(F.struct(F.col("text").alias("response"))).alias("body"))
    tail = F.when(k % 2 == 0, F.lit('","outcome":"success"}')).otherwise(F.lit('"}'))
    # {"prompt":"en" , "response":"... FF "...}
    raw = F.concat(plain(cut("head", 1)), plain(F.lit(",")), plain(F.expr("substring(body, 2, length(body) - 3)")), F.unhex(F.lit("FF")), plain(tail))
    objects = docs.select(F.concat(F.lit("d"), k.cast("string")).alias("path"), F.when(k % 7 == 0, F.unhex(F.lit("FFFE7B"))).otherwise(raw).alias("content"))
    return io.examples(objects).select("_path", "prompt", "response", "outcome")


@query("spec_preserved", r"""SELECT a.doc_id, len(list_distinct(list_filter(list_transform(string_split(b.text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT list_contains(list_transform(string_split(a.text, chr(10)), lambda y: trim(y)), x))))::INT AS missing FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def spec_preserved(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("spec"))
    return docs.join(after, "doc_id").select("doc_id", F.size(text.missing_spec_lines(F.col("spec"), F.col("text"))).alias("missing"))


@query("language_features", r"""SELECT doc_id, len(regexp_extract_all(text, ' (?:the|der|el|le) '))::INT AS articles, len(regexp_extract_all(text, '\|'))::INT AS bars FROM documents""")
def language_features(spark, sf_dir):
    counted = text.feature_counts(F.col("text"), {"articles": " (?:the|der|el|le) ", "bars": r"\|"})
    return load(spark, sf_dir, "documents").select("doc_id", counted.alias("c")).select("doc_id", *(F.coalesce(F.try_element_at("c", F.lit(k)), F.lit(0)).alias(k) for k in ("articles", "bars")))


_TURNS = """t AS (SELECT conv_id, turn, replace(text, ' ', chr(10)) || chr(10) AS lines FROM conversations), p AS (SELECT a.conv_id, a.turn, a.lines AS before, b.lines AS after FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query("text_diffs", f"""WITH {_TURNS} SELECT conv_id, turn, sha256(after) AS applied, (len(string_split(after, chr(10))) - len(string_split(before, chr(10))))::INT AS more_lines, before = after AS same FROM p""")
def text_diffs(spark, sf_dir):
    """Diffs of whole turns, a word a line: what applying them gives, and how many lines they add less those they remove."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.replace("text", F.lit(" "), F.lit("\n")), F.lit("\n")).alias("before"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("before").alias("after"))
    pairs = turns.join(after, ["conv_id", "turn"]).withColumn("diff", programs.diff_column(F.col("before"), F.col("after")))
    begins = lambda sign: F.size(F.filter(F.split("diff", "\n", -1), lambda x: x.startswith(f"{sign} ")))
    applied = programs.applied_column(F.col("before"), F.col("diff"))
    return pairs.select("conv_id", "turn", F.sha2(applied, 256).alias("applied"), (begins("+") - begins("-")).alias("more_lines"), (F.col("diff") == "").alias("same"))


@query("appended_lines", """SELECT doc_id, sha256(text || chr(10) || 'one line more' || chr(10)) AS applied, 1 AS n_added, 0 AS n_removed FROM documents WHERE length(text) > 0 AND NOT ends_with(text, chr(10))""")
def appended_lines(spark, sf_dir):
    """Diffs that append a line to whole texts: nothing but that line is added."""
    docs = load(spark, sf_dir, "documents").filter((F.length("text") > 0) & ~F.endswith("text", F.lit("\n"))).select("doc_id", F.concat("text", F.lit("\n")).alias("before"))
    pairs = docs.withColumn("after", F.concat("before", F.lit("one line more\n"))).withColumn("diff", programs.diff_column(F.col("before"), F.col("after")))
    begins = lambda sign: F.size(F.filter(F.split("diff", "\n", -1), lambda x: x.startswith(f"{sign} ")))
    return pairs.select("doc_id", F.sha2(programs.applied_column(F.col("before"), F.col("diff")), 256).alias("applied"), begins("+").alias("n_added"), begins("-").alias("n_removed"))


@query("reverse_patches", """SELECT a.item_id, sha256(b.text) AS restored, octet_length(encode(b.text)) AS bytes FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def reverse_patches(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("new"))
    old = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("new").alias("old"))
    patched = programs.patched_column(F.col("new"), programs.patch_column(F.col("new"), F.col("old")))
    return rows.join(old, "item_id").withColumn("patched", patched).select("item_id", F.sha2("patched", 256).alias("restored"), F.octet_length("patched").cast("long").alias("bytes"))


@query("dataset_records", r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(text, '/\*(?s:.*?)\*/', ' ', 'g'), '//[^\n]*', '', 'g'), chr(10)), lambda x: regexp_matches(x, '\S')))::INT AS n_lines, 'method' AS kind, 1 AS invariants FROM documents""")
def dataset_records(spark, sf_dir):
    """Every text as a program's comment-free lines, below a declaration that makes it one."""
    head = "method M()\n{\n  while true\n    invariant true\n  { }\n}\n"
    objects = load(spark, sf_dir, "documents").select(F.concat(F.lit("dataset/"), F.col("doc_id").cast("string")).alias("path"), F.encode(F.concat(F.lit(head), F.translate("text", "{}", "")), "UTF-8").alias("content"))
    rows = io.dataset_records(objects)
    lines = F.size(F.split("source", "\n", -1)) - 6
    return rows.select(F.replace("path", F.lit("dataset/")).cast("long").alias("doc_id"), lines.alias("n_lines"), F.col("methods")[0]["kind"].alias("kind"), F.col("methods")[0]["invariants"].alias("invariants"))
