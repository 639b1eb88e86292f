"""Sources and sinks: checkpoints as Parquet tables, JSON, program files, records."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded, first_fenced, is_success, parsed
from ..operators.tables import numbered_rows

#: Schemas of a checkpoint's tables.
SCHEMAS = {
    "objects": "path string, type string, parents array<string>, content binary, properties map<string,string>, interestingness double",
    "tasks": "id string, type string, parents array<string>, properties map<string,string>, interest_dependencies array<string>, priority double, work_status string, attempts int, worker_notes map<string,string>",
    "outcomes": "type string, status string, n long",
}
EXAMPLE = "prompt string, arguments map<string,string>, response string, outcome string, metadata map<string,string>"


def write_checkpoint(tables: dict[str, DataFrame], where: str) -> None:
    """Each table under its name. Spark's commit protocol shows a table whole or not at all."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{where}/{name}")


def read_checkpoint(spark: SparkSession, where: str, reset: bool = True) -> dict[str, DataFrame]:
    """The tables; with reset, tasks that were being worked on are ATTEMPTED again."""
    out = {name: spark.read.schema(schema).parquet(f"{where}/{name}") for name, schema in SCHEMAS.items()}
    if reset:
        status = F.col("work_status")
        out["tasks"] = out["tasks"].withColumn("work_status", F.when(status == "DOING", "ATTEMPTED").otherwise(status))
    return out


def scan_prefix(objects: DataFrame, prefix: str) -> DataFrame:
    """A prefix test reaches the Parquet scan."""
    return objects.filter(F.col("path").startswith(prefix))


def examples(objects: DataFrame, types: list[str] | None = None, prompts: list[str] | None = None, success_only: bool = False) -> DataFrame:
    """Examples parsed from objects' JSON, with the object's path as _path; content that isn't JSON is left out."""
    rows = objects if types is None else objects.filter(F.col("type").isin(*types))
    found = rows.select(F.col("path").alias("_path"), parsed(F.col("content"), EXAMPLE).alias("e")).filter("e IS NOT NULL AND e.prompt IS NOT NULL").select("_path", "e.*")
    if prompts is not None:
        found = found.filter(F.col("prompt").isin(*prompts))
    return found.filter(is_success(F.col("outcome"))) if success_only else found


def verified_programs(objects: DataFrame, kind: str, good: list[str], prefix: str = "dataset/") -> DataFrame:
    return objects.filter(F.col("path").startswith(prefix) & (F.col("type") == kind) & F.try_element_at("properties", F.lit("status")).isin(*good))


def program_files(spark: SparkSession, where: str, ending: str = ".dfy") -> DataFrame:
    """name, source of every file below a folder, one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").text(where, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return files.select(name.alias("name"), F.col("value").alias("source"))


#: Ending -> language.
LANGUAGES = {".dfy": "dafny", ".rs": "verus", ".c": "framac"}


def programs_in(spark: SparkSession, where: str) -> DataFrame:
    """name, source, language of a folder of programs; files of two languages are an error."""
    files = spark.read.option("recursiveFileLookup", "true").text(where, wholetext=True)
    found = files.select(F.input_file_name().alias("f"), "value").withColumn("ending", F.concat(F.lit("."), F.regexp_extract("f", r"\.([^./]+)$", 1))).filter(F.col("ending").isin(*LANGUAGES))
    kinds = [r[0] for r in found.select("ending").distinct().collect()]
    if len(kinds) != 1:
        raise ValueError(f"programs of one language are expected, found {sorted(kinds)}")
    return found.select(F.regexp_extract("f", r"([^/]+)\.[^./]+$", 1).alias("name"), F.col("value").alias("source"), F.lit(LANGUAGES[kinds[0]]).alias("language"))


def pooled(sources: dict[str, list[DataFrame]]) -> DataFrame:
    """label, and the rows of all its sources. Where sources have a language column, those of a label must be of one."""
    out = None
    for label, frames in sources.items():
        kinds = {r[0] for df in frames if "language" in df.columns for r in df.select("language").distinct().limit(2).collect()}
        if len(kinds) > 1:
            raise ValueError(f"sources of {label} are of different languages: {sorted(map(str, kinds))}")
        for df in frames:
            own = df.withColumn("label", F.lit(label))
            out = own if out is None else out.unionByName(own)
    return out


def jsonl(spark: SparkSession, where: str, schema: str, needed: list[str] | None = None) -> DataFrame:
    """Lines of JSON; blank lines, and lines without what is needed, are left out."""
    rows = spark.read.schema(schema).json(where)
    for c in needed or []:
        rows = rows.filter(F.col(c).isNotNull())
    return rows


def json_array(spark: SparkSession, where: str, schema: str, most: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", "true").json(where)
    return rows if most is None else rows.limit(most)


def converted(rows: DataFrame, text: str, good: list[str], most: int | None = None) -> DataFrame:
    """Rows whose status is good (missing: success) and that have a fenced block, with it as code."""
    kept = rows.filter(F.lower(F.coalesce("status", F.lit("success"))).isin(*good)).withColumn("code", first_fenced(F.col(text))).filter("code IS NOT NULL")
    return kept if most is None else kept.limit(most)


def annotated_corpus(sources: DataFrame, headers: DataFrame, results: DataFrame) -> DataFrame:
    """name, source (header first), status: success if all goals were proved. Files without a result are unknown."""
    joined = sources.join(headers.withColumnRenamed("source", "header"), "name", "left").join(results.select("name", "percent"), "name", "left")
    status = F.when(F.col("percent").isNull(), "unknown").when(F.col("percent") == 100, "success").otherwise("failed")
    return joined.select("name", F.concat_ws("\n", "header", "source").alias("source"), status.alias("status"))


def write_examples(rows: DataFrame, prefix: str, where: str, order: str) -> None:
    """Rows with path = prefix_000000, prefix_000001, ... in an order, as Parquet. Numbers are made by ranges of the
    order, whose starts come from a count for each range, so no task sees all rows."""
    numbered_rows(rows, order).withColumn("path", F.format_string("%s_%06d", F.lit(prefix), F.col("_n"))).drop("_n").write.mode("overwrite").parquet(where)


def materialized(objects: DataFrame) -> DataFrame:
    """path, content of the files that a store gives: each object's own, and with a history its older versions as .v1,
    .v2, ... from the oldest. A path that leaves the folder is an error."""
    from ..functions.programs import versions_column

    clean = F.regexp_like(F.col("path"), F.lit(r"^(?!/)(?!.*(?:^|/)\.\.(?:/|$)).+$"))
    safe = objects.withColumn("path", F.when(clean, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("path leaves the folder: "), F.col("path")))))
    newest = safe.select("path", "content")
    old = safe.filter(F.size("history") > 0).select("path", F.posexplode(F.reverse(F.slice(versions_column("content", "history"), 2, 1_000_000))).alias("k", "content"))
    return newest.unionByName(old.select(F.concat("path", F.lit(".v"), F.col("k") + 1).alias("path"), "content"))


def write_files(files: DataFrame, where: str) -> int:
    """Write path, content below a folder that the workers share, a file a row, and return how many."""
    def run(batches):
        import os

        import pyarrow as pa

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = posixpath.normpath(posixpath.join(where, path))
                if not at.startswith(where.rstrip("/") + "/"):
                    raise ValueError(f"path leaves the folder: {path}")
                os.makedirs(posixpath.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def unverified(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Programs (name, source) that an outcome (name, outcome) says don't verify."""
    return files.join(outcomes.filter(~is_success(F.col("outcome"))).select("name").distinct(), "name", "left_semi")


def benchmark(spark: SparkSession, where: str) -> DataFrame:
    """task_id, task, ground_truth of a benchmark in lines of JSON; tasks without a text are left out."""
    return jsonl(spark, where, "task_id string, task string, ground_truth string", ["task_id", "task"])


def dataset_records(objects: DataFrame, language: str = "dafny", prefix: str = "dataset/") -> DataFrame:
    """path, source (without comments and blank lines), methods (statistics of each declaration) of a store's programs."""
    from ..functions.programs import methods_column
    from ..functions.text import strip_c_comments, stripped

    rows = scan_prefix(objects, prefix).filter(F.col("content").isNotNull()).select("path", decoded("content").alias("text"))
    clean = stripped(F.col("text"), strip_c_comments) if language == "framac" else stripped(F.col("text"))
    return rows.select("path", clean.alias("source")).withColumn("methods", methods_column(F.col("source"), language))


def write_dataset(records: DataFrame, name: str, where: str) -> None:
    """Records as JSON below programs, and their name and number below about."""
    write_json(records, f"{where}/programs")
    write_json(records.agg(F.count("*").alias("n_programs")).select(F.lit(name).alias("name"), "n_programs"), f"{where}/about")


def write_results(results: DataFrame, metadata: dict[str, str], where: str) -> None:
    """Results of an evaluation as JSON below results, and what it was below metadata."""
    write_json(results, f"{where}/results")
    write_json(results.sparkSession.createDataFrame([(metadata,)], "metadata map<string,string>"), f"{where}/metadata")


def write_json(df: DataFrame, where: str) -> None:
    df.write.mode("overwrite").json(where)


def hub_records(objects: DataFrame) -> DataFrame:
    """id, group, content of successful programs; the id is the path without folder prefix and ending."""
    rows = objects.filter(F.try_element_at("properties", F.lit("status")) == "success")
    return rows.select(F.regexp_replace(F.regexp_replace("path", "^dataset/", ""), r"\.[a-z]+$", "").alias("id"), F.try_element_at("properties", F.lit("parent_idea")).alias("group"), decoded("content").alias("content"))
