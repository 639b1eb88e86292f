"""Extension points: languages with their program functions, and tasks with the records they train on. What is registered
by name can be found by name, and program functions can be called from SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import programs, text


@dataclass(frozen=True)
class Language:
    name: str
    ending: str
    metrics: tuple[str, ...]
    features: Callable[[Column], Column]
    methods: Callable[[Column], Column]
    stripped: Callable[[Column], Column]


@dataclass(frozen=True)
class Task:
    name: str
    prompt_type: str
    #: User text of an example's arguments (a map), and system text.
    user: Callable[[Column], Column]
    system: str


LANGUAGES: dict[str, Language] = {}
TASKS: dict[str, Task] = {}
METRICS = ("subject_word", "annotation_template", "loop_skeleton", "method_body_size", "lemma_body_size", "language_features", "annotations_per_method")


def add_language(own: Language) -> Language:
    if own.name in LANGUAGES:
        raise ValueError(f"language {own.name} is registered twice")
    LANGUAGES[own.name] = own
    return own


def add_task(own: Task) -> Task:
    if own.name in TASKS:
        raise ValueError(f"task {own.name} is registered twice")
    TASKS[own.name] = own
    return own


def tasks_by_prompt() -> dict[str, Task]:
    """Of the tasks of a prompt type the one that was registered first."""
    out: dict[str, Task] = {}
    for own in TASKS.values():
        out.setdefault(own.prompt_type, own)
    return out


def sections(arguments: Column, *names: str) -> Column:
    """`## name`, a line and the argument for each name that there is."""
    one = lambda n: F.concat(F.lit(f"## {n}\n"), F.try_element_at(arguments, F.lit(n)))
    return F.array_join(F.array_compact(F.array(*map(one, names))), "\n\n")


for _name, _ending in (("dafny", ".dfy"), ("verus", ".rs"), ("framac", ".c")):
    add_language(Language(
        _name, _ending, METRICS,
        lambda c, n=_name: programs.features_column(c, n), lambda c, n=_name: programs.methods_column(c, n),
        lambda c, n=_name: text.stripped(c, text.strip_c_comments if n == "framac" else text.strip_comments),
    ))
add_task(Task("fixer", "fixer", lambda a: sections(a, "program", "notes"), "Repair the program with a diff."))
add_task(Task("repair", "repair", lambda a: sections(a, "program", "notes"), "Repair the program with a diff."))
add_task(Task("implement", "implement", lambda a: sections(a, "idea", "program", "notes", "repo", "readme"), "Write a program for the idea."))
add_task(Task("lemma", "lemma_synth", lambda a: sections(a, "program", "lemma_name", "notes"), "Write the body of the lemma."))


def register_functions(spark: SparkSession) -> list[str]:
    """Make program functions callable from SQL; their names."""
    kinds = {"last_fenced": (programs.last_fenced, "string"), "apply_diff": (programs.apply_diff, "string"), "compute_diff": (programs.compute_diff, "string"), "longest_lemma": (programs.longest_lemma, "int"), "expression_template": (programs.template, "string"), "hollow_lemma": (programs.hollow, "string")}
    for name, (f, kind) in kinds.items():
        spark.udf.register(name, F.udf(lambda *a, f=f: None if any(x is None for x in a) else f(*a), kind, useArrow=True))
    return sorted(kinds)
