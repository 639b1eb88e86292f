"""Operator 5: document fingerprints from a Merkle tree.

A text splits at blank lines into sections, at newlines into paragraphs, and within a paragraph into leaves of LEAF
code points. Every node's hash is of its children's hashes, up to the root, so equal roots mean equal texts, and two
trees differ only along the branches that hold an edit. The splits lose nothing: leaves and separators give the text.

Two trees are compared from the root down. At each level the children that are equal from the front and from the back are
passed over whole, and only what is left between is paired and descended into. What equal branches hold makes the
likeness, and the paragraphs at which the descent ends are where the texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampType

from .common import table

#: Code points of a leaf.
LEAF = 64
#: Hex digits of a leaf's hash kept in a fingerprint. The root is of the whole hashes.
DIGITS = 16
#: Ranges of ids for each shuffle partition when finding a document's neighbour.
RANGES = 4


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def tree(text: Column) -> Column:
    """The sections of a text: array of struct<h, n, c>, a node's hash, its number of leaves and its children. A section's
    children are paragraphs, structs like it, and a paragraph's are leaf hashes. A null text is an empty one."""
    leaf = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0)), sha)
    node = lambda c, h, n: F.struct(sha(h).alias("h"), n.alias("n"), c.alias("c"))
    leaves = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaf))
    paragraphs = F.transform(leaves, lambda s: F.transform(s, lambda p: node(p, F.concat_ws(",", p), F.size(p))))
    return F.transform(paragraphs, lambda s: node(s, F.concat_ws(";", s["h"]), _sum(s["n"])))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def fingerprint(tree: Column) -> Column:
    """root:leaves, with `/` between sections, `;` between paragraphs and `,` between leaves."""
    shown = F.transform(tree, lambda s: F.concat_ws(";", F.transform(s["c"], lambda p: F.concat_ws(",", F.transform(p["c"], lambda x: F.substring(x, 1, DIGITS))))))
    return F.concat(sha(F.concat_ws("/", tree["h"])), F.lit(":"), F.concat_ws("/", shown))


def _front(x: Column, y: Column) -> Column:
    """How many elements of two arrays are equal from the front."""
    place = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False).cast("int")
    return F.when(place == 0, F.size(x)).otherwise(place - 1)


def _back(x: Column, y: Column, front: Column) -> Column:
    """How many of the elements after those equal from the front are equal from the back."""
    rest = lambda z: F.reverse(F.slice(z, front + 1, F.size(z) - front))
    return _front(rest(x), rest(y))


def _between(x: Column, front: Column, back: Column) -> Column:
    return F.slice(x, front + 1, F.size(x) - front - back)


def _outside(x: Column, front: Column, back: Column) -> Column:
    """Leaves of the nodes that are equal from the front and from the back."""
    return _sum(F.slice(x, F.lit(1), front)["n"]) + _sum(F.slice(x, F.size(x) - back + 1, back)["n"])


def compared(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """rows with name, struct<same, likeness, differing> of the trees in columns a and b: the leaves that equal branches
    hold; the likeness, 0 to 1, twice that against the leaves of both (1 for equal trees, below it for others); and the
    pairs of paragraphs that differ, array of struct<section, paragraph, other_section, other_paragraph> from 0. Of a
    paragraph that only one tree has, the other's place is null."""
    x, y = F.col(a), F.col(b)
    empty = F.array().cast("array<struct<h:string,n:int,c:array<string>>>")
    step = rows.withColumn("_f", _front(x["h"], y["h"])).withColumn("_k", _back(x["h"], y["h"], F.col("_f")))
    f, k = F.col("_f"), F.col("_k")
    left = lambda z, i: F.when(z.isNotNull(), f + i)
    zipped = F.arrays_zip(_between(x, f, k).alias("x"), _between(y, f, k).alias("y"))
    # Sections that differ, their paragraphs from the front, then from the back.
    opened = F.transform(zipped, lambda z, i: F.struct(left(z["x"], i).alias("s"), left(z["y"], i).alias("t"), F.coalesce(z["x"]["c"], empty).alias("x"), F.coalesce(z["y"]["c"], empty).alias("y")))
    opened = F.transform(opened, lambda z: F.struct(z["s"].alias("s"), z["t"].alias("t"), z["x"].alias("x"), z["y"].alias("y"), _front(z["x"]["h"], z["y"]["h"]).alias("f")))
    opened = F.transform(opened, lambda z: F.struct(z["s"].alias("s"), z["t"].alias("t"), z["x"].alias("x"), z["y"].alias("y"), z["f"].alias("f"), _back(z["x"]["h"], z["y"]["h"], z["f"]).alias("k")))
    step = step.withColumn("_opened", opened)
    inner = lambda z: F.transform(
        F.arrays_zip(_between(z["x"], z["f"], z["k"]).alias("x"), _between(z["y"], z["f"], z["k"]).alias("y")),
        lambda q, j: F.struct(F.when(q["x"].isNotNull(), z["s"]).alias("section"), F.when(q["x"].isNotNull(), z["f"] + j).alias("paragraph"), F.when(q["y"].isNotNull(), z["t"]).alias("other_section"), F.when(q["y"].isNotNull(), z["f"] + j).alias("other_paragraph"), q["x"]["c"].alias("x"), q["y"]["c"].alias("y")),
    )
    step = step.withColumn("_last", F.flatten(F.transform("_opened", inner)))
    # Leaves of paragraphs that differ: those at the same places, or those from the front and the back.
    placed = lambda q: F.size(F.filter(F.zip_with(q["x"], q["y"], lambda u, v: u == v), lambda e: F.coalesce(e, F.lit(False))))
    ends = F.transform(F.filter("_last", lambda q: q["x"].isNotNull() & q["y"].isNotNull()), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), placed(q).alias("p"), _front(q["x"], q["y"]).alias("f")))
    leaves = F.transform(ends, lambda q: F.greatest(q["p"], q["f"] + _back(q["x"], q["y"], q["f"])))
    whole = _sum(x["n"]) + _sum(y["n"])
    step = step.withColumn("_same", _outside(x, f, k) + _sum(F.transform("_opened", lambda z: _outside(z["x"], z["f"], z["k"]))) + _sum(leaves)).withColumn("_whole", whole)
    equal = (f == F.size(x)) & (F.size(x) == F.size(y))
    like = F.when(equal, 1.0).when(F.col("_whole") == 0, 0.0).otherwise(F.least(2.0 * F.col("_same") / F.col("_whole"), F.col("_whole") / (F.col("_whole") + 1.0)))
    places = F.transform("_last", lambda q: F.struct(*(q[c].alias(c) for c in ("section", "paragraph", "other_section", "other_paragraph"))))
    return step.withColumn(name, F.struct(F.col("_same").alias("same"), like.alias("likeness"), places.alias("differing"))).drop("_f", "_k", "_opened", "_last", "_same", "_whole")


def _cuts(cuts: list) -> Column:
    """An array that is one literal of the plan, however long."""
    return F.split(F.lit(",".join(map(str, cuts))), ",").cast(f"array<{'double' if any(isinstance(c, float) for c in cuts) else 'decimal(38,0)' if cuts and abs(max(cuts, key=abs)) >= 2**63 else 'bigint'}>")


def range_of(c: Column, cuts: list) -> Column:
    """How many of the sorted cuts aren't above c, found in two steps of about sqrt(len(cuts)) comparisons each."""
    if not cuts:
        return F.lit(0)
    wide = int(len(cuts) ** 0.5) + 1
    group = F.size(F.filter(_cuts(cuts[::wide]), lambda b: b <= c))
    first = F.greatest(group - 1, F.lit(0)) * wide
    return first + F.size(F.filter(F.slice(_cuts(cuts), first + 1, F.lit(wide)), lambda b: b <= c))


def _number(c: Column, kind) -> Column:
    """A number in the order of the ids: of texts their first 7 bytes, so texts that share these are in one range."""
    if isinstance(kind, StringType):
        return F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 14), 14, "0"), 16, 10).cast("long")
    return F.unix_micros(c.cast("timestamp")) if isinstance(kind, (DateType, TimestampType)) else c


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, _next: each row and the text of the row after it in descending order of ids, after the last the first.

    Ids fall in ranges, bounded by percentiles; a range is sorted in one task and spills. An id that is several of the
    bounds, and null if many ids are, holds as many ranges' rows, which are cut further by their texts' hashes. The first
    row of a range is also dealt to the range before it, as the guest its last row looks at. Where the bounds lie doesn't
    change results. Null ids are lowest; rows with the same id stand in order of their texts' hashes, null last.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    n = RANGES * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumns({"_tie": F.xxhash64("_text"), "_place": _number(F.col("_id"), kind)})
    # One read of the ids alone; n numbers come to the driver.
    found = rows.agg(F.percentile_approx("_place", [k / n for k in range(1, n)], 100 * n).alias("cuts"), F.count("*").alias("all"), F.count("_id").alias("given")).first()
    cuts = sorted(found["cuts"] or [])
    often = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1 and not isinstance(kind, StringType)}
    parts = F.lit(1)
    if often:
        at = F.array_position(_cuts(list(often)), F.col("_place"))
        parts = F.when(at > 0, F.element_at(_cuts(list(often.values())), at.cast("int"))).otherwise(1)
    blank = F.col("_place").isNull()
    parts = F.when(blank, F.lit(1 + (found["all"] - found["given"]) * n // max(1, found["all"]))).otherwise(parts)
    share = F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * parts).cast("int")
    # Within a range the ids above its bound come first, then its bound by parts, rows without a text last.
    part = F.when(parts == 1, 0).when(F.col("_text").isNull(), parts + 1).otherwise(1 + F.least(parts - 1, share)).cast("int")
    dealt = rows.withColumns({"_r": F.when(blank, F.lit(-1)).otherwise(range_of(F.col("_place"), sorted(set(cuts)))).cast("int"), "_u": part})
    head = F.max(F.struct("_id", F.col("_text").isNotNull().alias("given"), F.bitwise_not("_tie").alias("tie")))
    heads = sorted(dealt.groupBy("_r", "_u").agg(head.alias("h")).collect(), key=lambda r: (-r["_r"], r["_u"]))  # ranges and parts: n twice at most
    before = [(r["_r"], r["_u"], *r["h"], heads[k - 1]["_r"], heads[k - 1]["_u"]) for k, r in enumerate(heads)]  # the last goes on to the first
    ends = spark.createDataFrame(before, f"_hr int, _hu int, _hid {kind.simpleString()}, _hgiven boolean, _htie long, _br int, _bu int")
    is_head = F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_text").isNotNull() == F.col("_hgiven")) & (F.bitwise_not("_tie") == F.col("_htie"))
    at = lambda r, u, guest: F.struct(F.col(r).alias("r"), F.col(u).alias("u"), F.lit(guest).alias("guest"))
    joined = dealt.join(F.broadcast(ends), (F.col("_r") == F.col("_hr")) & (F.col("_u") == F.col("_hu")))
    placed = joined.withColumn("_at", F.explode(F.when(is_head, F.array(at("_r", "_u", False), at("_br", "_bu", True))).otherwise(F.array(at("_r", "_u", False)))))
    order = Window.partitionBy("_at.r", "_at.u").orderBy("_at.guest", F.desc_nulls_last("_id"), F.col("_text").isNull(), "_tie")
    return placed.select("_id", "_text", "_tie", "_at").withColumn("_next", F.lead(F.struct("_text")).over(order)).filter(~F.col("_at.guest")).select("_id", "_text", F.col("_next._text").alias("_next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every whole text. Null texts are empty ones; each row gives one row."""
    return docs.select(F.col(id_col), fingerprint(tree(F.col(text_col))).alias("fingerprint"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of op5: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and differing,
    the paragraphs at which the edited text differs.

    Null texts are empty ones, texts of any length are taken whole. Each row gives one row; with a single row, the next
    document is that row itself. Repeated and null ids stand in the order that with_next() says. An empty table gives an
    empty one. Other columns of docs, whatever their names, play no part.
    """
    rows = with_next(docs, id_col, text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_text"), F.coalesce("_next", F.lit("")).alias("_next"))
    third = F.floor(F.length("_text") / 3).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.expr("substring(_text, 1, length(_text) - cast(floor(length(_text) / 3) as int))"), F.substring(F.col("_next"), F.lit(1), third)))
    rows = rows.select("_id", F.length("_text").cast("long").alias("n_chars"), sha(F.col("_edited")).alias("edited_sha256"), *(tree(F.col(c)).alias(o) for c, o in (("_text", "_a"), ("_edited", "_b"), ("_next", "_c"))))
    rows = compared(compared(rows, "_a", "_b", "_ab"), "_a", "_c", "_ac")
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("_a")).alias("fingerprint"), fingerprint(F.col("_b")).alias("edited_fingerprint"),
        F.col("_ab.likeness").alias("near_edited"), F.col("_ac.likeness").alias("near_next"), F.col("_ab.differing").alias("differing"),
    )


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its text with the last third replaced from the next document, and against that one; n_differing
    is the number of paragraphs at which the edited text differs."""
    return edited_likeness(table(spark, sf_dir, "documents")).withColumn("differing", F.size("differing").cast("long")).withColumnRenamed("differing", "n_differing")


_TREE = r"""list_transform(list_transform(string_split({c}, chr(10) || chr(10)), lambda s: list_transform(list_transform(string_split(s, chr(10)),
      lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,64}}'), lambda x: sha256(x))),
      lambda p: {{'h': sha256(array_to_string(p, ',')), 'n': len(p), 'c': p}})),
      lambda s: {{'h': sha256(array_to_string(list_transform(s, lambda p: p.h), ';')), 'n': coalesce(list_sum(list_transform(s, lambda p: p.n)), 0), 'c': s}})"""
_FINGERPRINT = """sha256(array_to_string(list_transform({t}, lambda s: s.h), '/')) || ':' ||
      array_to_string(list_transform({t}, lambda s: array_to_string(list_transform(s.c, lambda p: array_to_string(list_transform(p.c, lambda x: x[1:16]), ',')), ';')), '/')"""
_FRONT = "coalesce(nullif(list_position(list_transform(list_zip({x}, {y}), lambda e: e[1] IS NOT DISTINCT FROM e[2]), false), 0) - 1, len({x}))"


def _sql_front(x: str, y: str) -> str:
    return _FRONT.format(x=x, y=y)


def _sql_back(x: str, y: str, f: str) -> str:
    return _sql_front(f"list_reverse({x}[{f} + 1:])", f"list_reverse({y}[{f} + 1:])")


def _sql_hashes(x: str) -> str:
    return f"list_transform({x}, lambda e2: e2.h)"


def _sql_leaves(x: str, f: str, k: str) -> str:
    return f"coalesce(list_sum(list_transform({x}[1:{f}] || {x}[len({x}) - {k} + 1:], lambda e3: e3.n)), 0)"


OP5_SQL = f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS after
  FROM documents),
edited AS (
  SELECT *, length(text)::BIGINT AS n_chars, substring(text, 1, length(text) - length(text) // 3) || substring(after, 1, length(text) // 3) AS edited FROM ordered),
trees AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_TREE.format(c="text")} AS a, {_TREE.format(c="edited")} AS e, {_TREE.format(c="after")} AS n FROM edited),
paired AS (
  SELECT doc_id, 'edited' AS kind, a AS x, e AS y FROM trees UNION ALL SELECT doc_id, 'next', a, n FROM trees),
fronts AS (SELECT *, {_sql_front(_sql_hashes("x"), _sql_hashes("y"))} AS f FROM paired),
backs AS (SELECT *, {_sql_back(_sql_hashes("x"), _sql_hashes("y"), "f")} AS k FROM fronts),
sections AS (
  SELECT doc_id, kind, f = len(x) AND len(x) = len(y) AS equal, list_sum(list_transform(x, lambda s: s.n)) + list_sum(list_transform(y, lambda s: s.n)) AS whole,
         {_sql_leaves("x", "f", "k")} AS same,
         list_transform(range(1, greatest(len(x), len(y)) - f - k + 1), lambda i: {{
           'x': CASE WHEN i <= len(x) - f - k THEN x[f + i].c ELSE [] END, 'y': CASE WHEN i <= len(y) - f - k THEN y[f + i].c ELSE [] END}}) AS opened
  FROM backs),
opened AS (
  SELECT * EXCLUDE (opened), list_transform(list_transform(opened,
         lambda z: {{'x': z.x, 'y': z.y, 'f': {_sql_front(_sql_hashes("z.x"), _sql_hashes("z.y"))}}}),
         lambda z: {{'x': z.x, 'y': z.y, 'f': z.f, 'k': {_sql_back(_sql_hashes("z.x"), _sql_hashes("z.y"), "z.f")}}}) AS opened
  FROM sections),
paragraphs AS (
  SELECT * EXCLUDE (opened), coalesce(list_sum(list_transform(opened, lambda z: {_sql_leaves("z.x", "z.f", "z.k")})), 0) AS more,
         flatten(list_transform(opened, lambda z: list_transform(range(1, greatest(len(z.x), len(z.y)) - z.f - z.k + 1), lambda i: {{
           'x': CASE WHEN i <= len(z.x) - z.f - z.k THEN z.x[z.f + i].c END, 'y': CASE WHEN i <= len(z.y) - z.f - z.k THEN z.y[z.f + i].c END}}))) AS last
  FROM opened),
leaves AS (
  SELECT doc_id, kind, equal, whole, len(last) AS n_differing, same + more + coalesce(list_sum(list_transform(list_transform(
         list_filter(last, lambda q: q.x IS NOT NULL AND q.y IS NOT NULL),
         lambda q: {{'x': q.x, 'y': q.y, 'p': len(list_filter(list_zip(q.x, q.y), lambda e: e[1] = e[2])), 'f': {_sql_front("q.x", "q.y")}}}),
         lambda q: greatest(q.p, q.f + {_sql_back("q.x", "q.y", "q.f")}))), 0) AS same
  FROM paragraphs),
likeness AS (
  SELECT doc_id, kind, n_differing, CASE WHEN equal THEN 1.0 WHEN whole = 0 THEN 0.0 ELSE least(2.0::DOUBLE * same / whole, whole / (whole + 1.0::DOUBLE)) END::DOUBLE AS likeness FROM leaves)
SELECT t.doc_id, n_chars, edited_sha256, {_FINGERPRINT.format(t="a")} AS fingerprint, {_FINGERPRINT.format(t="e")} AS edited_fingerprint,
       l.likeness AS near_edited, m.likeness AS near_next, l.n_differing::BIGINT AS n_differing
FROM trees t JOIN likeness l ON t.doc_id = l.doc_id AND l.kind = 'edited' JOIN likeness m ON t.doc_id = m.doc_id AND m.kind = 'next'
"""
