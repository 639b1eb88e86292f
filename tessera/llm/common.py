"""What the operators of this subpackage share: paths, cut lineage, words, batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset a temporary one is made
    and kept for the session, on a local master only: a cluster's machines wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders of settle() that still stand.
_standing: set[str] = set()


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, so a lost
    executor costs a read of the files, never the work before. What unsettle() or scratch() don't remove goes when
    the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _standing.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def unsettle(*tables: DataFrame | None) -> None:
    """Remove tables that settle() wrote and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path in _standing:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _standing.discard(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables settled within are removed at its end, less those passed to what it gives."""
    before, kept = set(_standing), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._tessera_path)
        return df

    yield keep
    for path in _standing - before - kept:
        _remove(spark, path)


#: Row numbers that may be broadcast: 8 MB of them.
MOST_SENT = 1_000_000


def numbered(df: DataFrame) -> DataFrame:
    """df with _row, a number of its own for each row, and renamed() columns, so that names can't clash. A written table: a
    plan made anew might cut the files elsewhere and number other rows, where executors came or went."""
    low = [c.lower() for c in df.columns]
    names = [c if re.fullmatch(r"(?!c\d+$)[A-Za-z][A-Za-z0-9_]*", c, re.ASCII) and low.count(c.lower()) == 1 else f"c{k}" for k, c in enumerate(df.columns)]
    out = settle(df.toDF(*names).withColumn("_row", F.monotonically_increasing_id()))
    out._tessera_names = df.columns
    return out


def renamed(rows: DataFrame, name: str) -> str:
    """What numbered() calls a column of its input: its name, or c and its place where names aren't plain or not alone."""
    return rows.columns[rows._tessera_names.index(name)]


#: Bitmaps of 32,768 numbers, 4 KB each, that may be sent to all tasks: 64 MB.
BUCKETS = 16_384


def among(rows: DataFrame, number: Column, chosen: DataFrame, inside: bool = True) -> DataFrame:
    """Those of rows whose number (a long, not null) is in chosen (a table of one column of longs), or the others. Numbers
    are sent to all tasks as bitmaps, so that texts stay where they are; more than BUCKETS of these are joined by a shuffle."""
    own = F.col(chosen.columns[0])
    bits = chosen.select(F.bitmap_bucket_number(own).alias("_bucket"), F.bitmap_bit_position(own).alias("_bit")).repartition("_bucket")
    maps = settle(bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    if maps.count() > BUCKETS:
        return rows.withColumn("_number", number).join(chosen.select(own.alias("_number")), "_number", "left_semi" if inside else "left_anti").select(*rows.columns)
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_in = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number(number) == F.col("_bucket"), "inner" if inside else "left")
    return joined.filter(is_in if inside else ~is_in).select(*rows.columns)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The input of numbered() less the rows in dropped (a settled table of _row)."""
    return among(rows, F.col("_row"), dropped, inside=False).drop("_row").toDF(*rows._tessera_names)


def frequent(df: DataFrame, count: str, most: int, key: str) -> DataFrame:
    """The rows of df with the largest counts, at most `most` of them: down to the lowest step of the counts' logarithm
    that still fits whole, and of the step below about half of what is left, by a hash of the key. Only a row for each
    step comes to the driver."""
    step = F.floor(F.log2(F.col(count)) * 16)
    left, taken = most, F.lit(False)
    for r in df.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():  # 64 * 16 rows at most
        if r["n"] > left:
            part = F.pmod(F.xxhash64(key, F.lit(23)), F.lit(2**20)) < int(2**19 * left / r["n"])
            taken |= (step == r["s"]) & part if left >= 1_000 else F.lit(False)
            break
        left -= r["n"]
        taken = step >= r["s"]
    return df.filter(taken)


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Characters and array elements that leave a worker in one batch, about, and bytes of texts that become Python objects
#: at a time.
BATCH = 4_000_000


def weight(row: tuple) -> int:
    """About how many characters or elements a row has."""
    n = 8
    for x in row:
        if x is not None and x.__class__ not in _PLAIN:
            n += len(x) if hasattr(x, "__len__") else 0
    return n


_PLAIN = (int, float, bool)


def bounded(spark: SparkSession) -> None:
    """From now on the session's Arrow batches for Python workers are of about BATCH bytes at most, or a row where that is
    longer: executor and worker hold two or more of them for each task. A smaller bound of the session's own stays."""
    own = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < own <= BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], Iterable[tuple]]], schema: str, rows: int = 20_000) -> DataFrame:
    """Arrow batches of df through a function made once per task. It takes columns of some rows as lists and gives row
    tuples, which leave in batches of `rows` or about BATCH characters at most, so memory stays bounded whatever the
    lengths of texts: what is held at a time is a batch, and a single row where that is longer. Whole Arrow batches, where
    it gives any, pass as they are."""
    from pyspark.sql.types import StructType

    bounded(df.sparkSession)
    parsed, out = StructType.fromDDL(schema), arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held, size = make(), [], 0
        for made in chain((step([c.to_pylist() for c in part.columns]) for batch in batches for part in slices(batch)), (x() for x in (getattr(step, "end", tuple),))):
            for row in made:
                if row.__class__ is pa.RecordBatch:
                    yield row
                    continue
                held.append(row)
                size += weight(row)
                if len(held) >= rows or size >= BATCH:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)
        del step, held
        release()

    def pack(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part), out)], schema=out)

    return df.mapInArrow(run, parsed)


def release() -> None:
    """Give memory that a task no longer needs back to the system: its worker waits for other tasks or other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # elsewhere than in glibc there's nothing to trim
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 256 rows, fewer where rows are long."""
    most = max(1, min(256, batch.num_rows * BATCH // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)
