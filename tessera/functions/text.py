"""Text functions that are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_comments(source: Column) -> Column:
    """Block comments become a space, line comments nothing."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")


def strip_c_comments(source: Column) -> Column:
    """As strip_comments(), but annotations, comments that begin with an @, stay."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*(?!@).*?\*/", " "), r"//(?!@)[^\n]*", "")


def stripped(source: Column, strip=strip_comments) -> Column:
    """Without comments and blank lines."""
    return F.array_join(F.filter(F.split(strip(source), "\n", -1), lambda x: F.regexp_like(x, F.lit(r"\S"))), "\n")


def split_identifier(name: Column) -> Column:
    """Lower-case words of two letters or more of a camelCase or snake_case name. A part with a digit in it is none."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "'+$", ""), r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(s, r"[_\s]+", -1), lambda p: F.regexp_like(p, F.lit(r"^\p{L}{2,}$"))), F.lower)


def annotations(source: Column, keyword: str) -> Column:
    """Texts after the keyword, one for each line that it begins."""
    return F.regexp_extract_all(source, F.lit(rf"(?m)^\s*{keyword}\s+(.+)"), F.lit(1))


def feature_counts(source: Column, patterns: dict[str, str]) -> Column:
    """map of the patterns that occur -> how often."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.regexp_count(source, F.lit(p)).alias("value")) for k, p in patterns.items()))
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"] > 0))


def first_fenced(text: Column) -> Column:
    """Content of the first fenced block, trimmed; null without one."""
    found = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_.+-]*[ \t]*\n(.*?)```", 1)
    return F.when(F.regexp_like(text, F.lit(r"(?s)```[A-Za-z0-9_.+-]*[ \t]*\n.*?```")), F.regexp_replace(found, r"^\s+|\s+$", ""))


def slugify(text: Column, most: int | None = None) -> Column:
    """The whole text, or its first `most` characters as a slug."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return dashed if most is None else F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last three then dots."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def is_success(outcome: Column, good: tuple[str, ...] = ("success",)) -> Column:
    return F.lower(F.coalesce(outcome, F.lit(""))).isin(*good)


def missing_spec_lines(spec: Column, program: Column) -> Column:
    """Trimmed non-empty lines of the spec that the program hasn't."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_except(lines(spec), lines(program))


def idea_comment(program: Column) -> Column:
    """Text of the first line that begins with `// idea:`, in any case."""
    return F.trim(F.regexp_extract(program, r"(?im)^\s*//\s*idea:\s*(.*)$", 1))


def without_idea(program: Column) -> Column:
    return F.array_join(F.filter(F.split(program, "\n", -1), lambda x: ~F.regexp_like(x, F.lit(r"(?i)^\s*//\s*idea:"))), "\n")


def run_label(path: Column) -> Column:
    """`Label:path` -> Label; else the file's name without its ending."""
    plain = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.when(F.instr(path, ":") > 1, F.regexp_extract(path, "^([^:]+):", 1)).otherwise(plain)


def parsed(content: Column, schema: str) -> Column:
    """Struct from JSON bytes, null where they aren't JSON; bad UTF-8 doesn't stop it."""
    return F.from_json(decoded(content), schema, {"mode": "PERMISSIVE"})


def decoded(content: Column | str) -> Column:
    """Text of UTF-8 bytes; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def property_filter(properties: Column, wanted: list[str]) -> Column:
    """All of `key` (present and truthy) or `key=value`."""
    out = F.lit(True)
    for w in wanted:
        key, eq, value = w.partition("=")
        own = F.try_element_at(properties, F.lit(key))
        out = out & F.coalesce((own == value) if eq else ~F.lower(own).isin("", "false", "0", "none", "null"), F.lit(False))
    return out


def n_tokens(content: Column) -> Column:
    """Tokens of a text by the usual proxy, a token for each four bytes: no tokenizer is asked."""
    return F.ceil(F.octet_length(content) / 4).cast("int")


def shorter_than(content: Column, most: int) -> Column:
    return n_tokens(content) < most
