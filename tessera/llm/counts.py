"""Operator 3: token counts without ids.

Each distinct pre-token is encoded once, to a count only. Per-document pre-token frequencies are then joined to
the counts and summed. The join is split by frequency: counts of the HOT most frequent pre-tokens, a fixed number,
go to every task, which adds up most of a document where it reads it; the other pre-tokens are at most one in HOT of all
each, so they shuffle on the pre-token without a hot key. Long pre-tokens are sent as a hash, so a frequent one, such as a
boilerplate address, is no hot key either, and the broadcast is bounded in bytes.
"""

from __future__ import annotations

from collections import Counter
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, map_rows, settle, table
from .pieces import default_model, model

#: Pre-tokens whose counts are sent to all tasks. Bounds that broadcast, and nothing else.
HOT = 400_000
#: Longer pre-tokens are known by a hash where they are broadcast.
HOT_CHARS = 64
#: Distinct pre-tokens, and characters of them, that a task holds before it passes their frequencies on.
HELD, HELD_CHARS = 400_000, 16_000_000


def short(pretoken: str) -> str:
    """What a pre-token is known by in the broadcast."""
    return pretoken if len(pretoken) <= HOT_CHARS else f"\0{md5(pretoken.encode()).hexdigest()}"


def pretoken_frequencies(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """pretoken, n: how often each occurs in all whole texts. Tasks add up what they read before it shuffles."""

    def make():
        m = model(model_path)
        held: Counter = Counter()
        chars = 0

        def step(cols):
            nonlocal chars
            for t in cols[0]:
                held.update(m.pretokens(t))
                chars += len(t or "")  # no fewer than the characters of what is new
                if len(held) > HELD or chars > HELD_CHARS:
                    yield from flush()

        def flush():
            nonlocal chars
            yield from held.items()
            held.clear()
            chars = 0

        step.end = flush
        return step

    return map_rows(docs.select(text_col), make, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def count_pieces(pretokens: DataFrame, model_path: str) -> DataFrame:
    """pretoken, n, pieces: each pre-token is encoded once."""

    def make():
        m = model(model_path)

        def step(cols):
            for p, n in zip(*cols):
                yield p, n, len(m.encode_key(p))

        return step

    return map_rows(pretokens.select("pretoken", "n"), make, "pretoken string, n long, pieces int")


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    A null text is an empty one: 0 bytes, 0 tokens. Each input row gives one row, so repeated rows and null or
    repeated ids come out as often as they went in; an empty table gives an empty one. Texts of any length are counted
    whole. Pre-tokens of equal frequency are broadcast together or not at all, which changes no result. Other columns of
    docs, whatever their names, play no part.
    """
    spark = docs.sparkSession
    counted = settle(count_pieces(pretoken_frequencies(docs, model_path, text_col), model_path))
    name = F.when(F.length("pretoken") <= HOT_CHARS, F.col("pretoken")).otherwise(F.concat(F.lit("\0"), F.md5(F.col("pretoken").cast("binary"))))
    hot_rows = frequent(counted, "n", HOT, "pretoken").select(name.alias("pretoken"), "pieces").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(hot_rows["pretoken"].to_pylist(), hot_rows["pieces"].to_pylist())))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m, known = model(model_path), hot.value

        def step(cols):
            for row, i, size, t in zip(*cols):
                total, rest = 0, {}
                for p in m.pretokens(t):
                    k = known.get(p)
                    if k is None and (len(p) <= HOT_CHARS or (k := known.get(short(p))) is None):
                        rest[p] = rest.get(p, 0) + 1
                    else:
                        total += k
                # A key of its own deals this row out like the others; what it might match doesn't count, as known is set.
                yield row, i, size, total, f"\0{row}", None
                for p, n in rest.items():
                    yield row, None, None, None, p, n

        return step

    # A row's number within its partition of the input: equal after a task is run again, as the files are.
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"), F.col(text_col).alias("_text"))
    mapped = map_rows(numbered, make, f"_row long, _id {kind}, n_bytes long, known long, pretoken string, freq int")
    joined = mapped.join(counted.select("pretoken", "pieces"), "pretoken", "left").withColumn("known", F.coalesce("known", (F.col("freq") * F.col("pieces")).cast("long")))
    return (
        joined.groupBy("_row")
        .agg(F.max("_id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum("known").alias("n_tokens"))
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_model())
