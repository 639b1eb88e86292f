"""Records for supervised fine-tuning, from stored examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.programs import applied_column
from ..functions.registry import tasks_by_prompt
from ..functions.text import is_success

MESSAGE = "array<struct<role:string,content:string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def program_of(prompt: Column, arguments: Column, response: Column) -> Column:
    """The program that an example's response stands for: itself for whole programs, applied to the argument for diffs,
    null for prompts that make none."""
    own = F.try_element_at(arguments, F.lit("program"))
    return F.when(prompt.isin("implement", "initiate", "generate"), response).when(prompt.isin("repair", "extend", "edit", "fixer"), applied_column(own, response))


def sft_records(examples: DataFrame, systems: dict[str, str], success_only: bool = True) -> DataFrame:
    """prompt, completion of the examples whose prompt has a system text; user text is the arguments in order of names.

    Ideas stay if a successful implementation took them up: a left semi join on the idea's text.
    """
    good = is_success(F.col("outcome"))
    rows = examples.filter(F.col("prompt").isin(*systems))
    ideas, others = rows.filter("prompt = 'idea'"), rows.filter("prompt <> 'idea'")
    taken = examples.filter((F.col("prompt") == "implement") & good).select(F.try_element_at("arguments", F.lit("idea")).alias("response")).distinct()
    chosen = others.filter(good) if success_only else others
    kept = chosen.unionByName(ideas.join(taken, "response", "left_semi").select(*chosen.columns))
    system = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(systems.items()) for x in kv]), F.col("prompt"))
    user = F.array_join(F.transform(F.array_sort(F.map_entries("arguments")), lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n"), F.coalesce(e["value"], F.lit("")))), "\n\n")
    return kept.select("prompt", messages(system, user).alias("messages"), F.array(message("assistant", F.col("response"))).alias("completion"))


def tasks_of(examples: DataFrame, tasks: DataFrame) -> DataFrame:
    """Examples with the task class of their prompt_type; of classes registered for the same, the first (least ord)."""
    first = tasks.groupBy("prompt_type").agg(F.min_by("task", "ord").alias("task"))
    return examples.join(first, F.col("prompt") == F.col("prompt_type"))


def task_records(examples: DataFrame, success_only: bool = True) -> DataFrame:
    """prompt, messages, completion of the examples whose prompt a registered task takes, worded by that task; those without
    arguments or response are left out."""
    rows = examples.filter((F.size("arguments") > 0) & F.col("response").isNotNull())
    rows = rows.filter(is_success(F.col("outcome"))) if success_only else rows
    made = F.lit(None).cast(MESSAGE)
    for kind, task in tasks_by_prompt().items():
        made = F.when(F.col("prompt") == kind, messages(F.lit(task.system), task.user(F.col("arguments")))).otherwise(made)
    return rows.select("prompt", made.alias("messages"), F.array(message("assistant", F.col("response"))).alias("completion")).filter("messages IS NOT NULL")


def chat_records(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, prompt (all turns but the last), completion (the last, if it is the assistant's). A record is a row with a whole
    conversation, so that is what one task holds at a time."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))))
    rows = turns.groupBy(conv).agg(ordered.alias("m"))
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.filter(F.element_at("m", -1)["role"] == "assistant").select(conv, F.slice(plain, 1, F.size("m") - 1).alias("prompt"), F.slice(plain, F.size("m"), 1).alias("completion"))
