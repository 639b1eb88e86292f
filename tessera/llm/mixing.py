"""Operator 7: mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents stand in the order of the key; a distributed
prefix sum of their sizes says where each begins, and the source's budget cuts the order at an exact word. A budget
above the source's size takes whole epochs first. The prefix sum has two levels, slices of the key's range within a
source and documents within a slice, so a source that holds most rows is still spread over SLICES tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, settle, table

#: Slices of the key range in each source: a power of 16, as slices are leading hex digits of the key.
SLICE_DIGITS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Sources whose cuts are sent to all tasks; with more, documents are joined to them by a shuffle.
MOST_SOURCES = 10_000
#: Share of all words that the mix takes, and how often a source may be repeated at most.
SHARE, EPOCHS = 1.5, 2.0


def random_key(id_col: Column, seed: int) -> Column:
    """Hex digits, uniform, the same in every run. A null id has a key too."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def ranked_sources(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size and the weight of its place in code-point order, null last. One row for each source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """source, source_size, target of each source, from source and source_size.

    Sharing by weight and resharing the excess over epochs * source_size, until no source is above, ends at a water
    level: sources in the order of cap / weight are full as long as the level that the others would get is not below
    their own. Both sums over that order are prefix sums over one row for each source.
    """
    ranked = ranked_sources(sources, weights).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    below, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = ranked.select(
        "*",
        (F.sum("source_size").over(all_rows) * F.lit(float(share))).alias("budget"),
        F.sum("weight").over(all_rows).alias("all_weight"),
        F.coalesce(F.sum("cap").over(below), F.lit(0.0)).alias("cap_below"),
        F.coalesce(F.sum("weight").over(below), F.lit(0.0)).alias("weight_below"),
    ).withColumn("level", (F.col("budget") - F.col("cap_below")) / (F.col("all_weight") - F.col("weight_below")))
    # Full: the level that is left when all before it are full doesn't lie below its own cap.
    full = placed.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(all_rows)
    return full.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level["level"] * F.col("weight")).alias("target"))


def _placed(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[int, ...], share: float, epochs: float, seed: int) -> DataFrame:
    """_id, source, size, key, source_size, target, whole (epochs that the source is taken as a whole) and part (words
    taken of the document in the last epoch)."""
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    sized = settle(sized.withColumn("key", random_key(F.col("_id"), seed)).withColumn("slice", F.substring("key", 1, SLICE_DIGITS)))
    slices = settle(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    aim = settle(targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, epochs))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("slice_start"))
    # At most 16 ** SLICE_DIGITS rows for each source, however many documents.
    plan = settle(starts.join(aim, F.col("_source").eqNullSafe(F.col("source"))).select("_source", "_slice", "slice_start", "source_size", "target"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("slice_start") - F.col("before")))
    return joined.select("_id", "source", "size", "key", "source_size", "target", whole.cast("long").alias("whole"), part.cast("long").alias("part"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row for each row of docs.

    Size: words of the text (null: 0). taken: words that the mix takes of the document, repeats counted; a source's
    sum to its target, rounded down. Null sources are one source, the last. Rows with the same id stand in order of
    size; equal rows are interchangeable. A source without words has target 0. Texts of any length are counted whole. An
    empty table gives an empty one. Other columns of docs, whatever their names, play no part.
    """
    placed = _placed(docs, id_col, source_col, text_col, weights, share, epochs, seed)
    return placed.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = 7) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them: whole epochs, and once more up to the
    source's budget. The document that the budget cuts stays whole, and documents without words stay as often as its
    whole epochs, once at least. Texts don't shuffle as long as sources are few enough to send: a source's cut is the
    place of its last document."""
    place = F.struct("key", "_id", "size")
    cuts = settle(_placed(docs, id_col, source_col, text_col, weights, share, epochs, seed).groupBy(F.col("source").alias("_cut_source")).agg(F.max("whole").alias("_whole"), F.max(F.when(F.col("part") > 0, place)).alias("_last")))
    few = cuts.count() <= MOST_SOURCES
    names = [f"c{k}" for k in range(len(docs.columns))]  # clashing names can't meet
    at = {c: names[k] for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*names).withColumn("_size", n_words(F.col(at[text_col])))
    joined = rows.join(F.broadcast(cuts) if few else cuts, F.col(at[source_col]).eqNullSafe(F.col("_cut_source")), "left")
    own = F.struct(random_key(F.col(at[id_col]), seed).alias("key"), F.col(at[id_col]).alias("_id"), F.col("_size").alias("size"))
    copies = F.col("_whole") + F.when((F.col("_size") > 0) & F.coalesce(own <= F.col("_last"), F.lit(False)), 1).otherwise(0)
    copies = F.when(F.col("_size") == 0, F.greatest(F.lit(1), copies)).otherwise(copies)
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*names).toDF(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight
  FROM sources),
placed AS (
  SELECT *, cap / weight AS own,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_below,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weight_below,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight
  FROM ranked),
levels AS (SELECT *, (budget - cap_below) / (all_weight - weight_below) AS level FROM placed),
aim AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap THEN cap
              ELSE (SELECT level FROM levels WHERE level * weight < cap ORDER BY own, source IS NULL, encode(source) LIMIT 1) * weight END AS target
  FROM levels),
ordered AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN aim a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * size
        + greatest(0, least(size, floor(target) - CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM ordered
"""
