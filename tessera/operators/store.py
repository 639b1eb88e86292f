"""The object and task store: status, lineage, priority, and rolling statistics of calls."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Steps, running_sums

OPEN = ("NEW", "ATTEMPTED")


def outcome_counts(attempts: DataFrame, type_col: str, status_col: str) -> DataFrame:
    return attempts.groupBy(type_col, status_col).agg(F.count("*").alias("n"))


def current_tasks(log: DataFrame, task: str, type_col: str, status: str, order: list[str]) -> DataFrame:
    """type, status, n: tasks by their latest state in a log. The latest is an aggregate, not a sort of the log."""
    latest = log.groupBy(task).agg(F.max(F.struct(*order, type_col, status)).alias("m")).select(f"m.{type_col}", f"m.{status}")
    return latest.groupBy(type_col, status).agg(F.count("*").alias("n"))


def done_rate(log: DataFrame, type_col: str, done: Column) -> DataFrame:
    return log.groupBy(type_col).agg((F.sum(done.cast("long")) / F.count("*")).alias("rate"))


def lineage(parents: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, ancestor, distance: every ancestor of the start nodes (all, if there are none) at its least distance.

    parents: node, parent. From some nodes the search goes breadth first: a step joins the last step's ancestors alone, and
    ends when there are no new ones. For all nodes paths double: paths of up to n steps, joined with themselves, are those
    of up to 2 n, so a chain of any length takes as many rounds as its length has bits. Cycles end either way; a node is
    never its own ancestor.
    """
    edges = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p")).filter("_n <> _p").distinct()
    if start is None:
        return _doubled(edges)
    steps = Steps(parents.sparkSession)
    last = steps.add(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).distinct())
    for step in count(1):
        after = last.join(edges, F.col("ancestor") == F.col("_n")).select("node", F.col("_p").alias("ancestor")).distinct()
        new = after.join(steps.all(), ["node", "ancestor"], "left_anti")
        last = steps.add(new.select("node", "ancestor", F.lit(step).alias("distance")))
        if last.isEmpty():
            break
    return steps.all().filter("distance > 0")


def _doubled(edges: DataFrame) -> DataFrame:
    tables = Steps(edges.sparkSession)
    paths = tables.add(edges.select(F.col("_n").alias("node"), F.col("_p").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1  # all least paths of up to so many steps are there
    while not paths.filter(F.col("distance") == reach).isEmpty():
        # The longest ones alone can go on: a least path of more than `reach` steps begins with one of just that many.
        far = paths.filter(F.col("distance") == reach).select("node", F.col("ancestor").alias("_via"))
        on = paths.select(F.col("node").alias("_via"), "ancestor", (F.col("distance") + reach).cast("int").alias("distance"))
        joined = far.join(on, "_via").select("node", "ancestor", "distance").filter("node <> ancestor")
        paths = tables.add(paths.unionByName(joined).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        reach *= 2
    return paths


def effective_priority(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """id, priority, effective: priority times the interestingness of each object that the task depends on; objects that
    don't exist don't count."""
    each = tasks.select("id", F.explode_outer("interest_dependencies").alias("path"))
    factor = each.join(objects.select("path", "interestingness"), "path", "left").groupBy("id").agg(F.product(F.coalesce("interestingness", F.lit(1.0))).alias("factor"))
    return tasks.join(factor, "id").select("id", "priority", (F.col("priority") * F.col("factor")).alias("effective"))


def claim(tasks: DataFrame, n: int) -> DataFrame:
    """The n open tasks of the highest effective priority, ties by id."""
    return tasks.filter(F.col("work_status").isin(*OPEN)).orderBy(F.desc("effective"), "id").limit(n)


def propagate_priority(edges: DataFrame, updates: DataFrame, gamma: float, own: DataFrame | None = None) -> DataFrame:
    """node, factor: the largest factor * gamma^distance over the updates of its descendants; edges: node, ancestor,
    distance. own (node, priority): priority too, which a node keeps where that is larger."""
    factors = edges.join(updates, "node").groupBy(F.col("ancestor").alias("node")).agg(F.max(F.col("factor") * F.pow(F.lit(gamma), "distance")).alias("factor"))
    if own is None:
        return factors
    return own.join(factors, "node", "left").select("node", "factor", F.greatest("priority", F.coalesce("factor", F.col("priority"))).alias("priority"))


def added_tasks(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """tasks and new ones in state NEW. An id that is missing or taken already, by a task or by a new one before it (in
    order of ord), gets a suffix made of the row's own values."""
    taken = tasks.select(F.col("id").alias("_taken")).distinct()
    numbered = new.withColumn("id", F.coalesce("id", F.lit(""))).withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("ord")))
    marked = numbered.join(taken, F.col("id") == F.col("_taken"), "left")
    name = F.when((F.col("id") == "") | F.col("_taken").isNotNull() | (F.col("_k") > 1), F.concat("id", F.md5(F.concat_ws("|", "id", "type", F.col("ord").cast("string"))))).otherwise(F.col("id"))
    fresh = marked.withColumns({"id": name, "work_status": F.lit("NEW"), "attempts": F.lit(0), "priority": F.lit(1.0)})
    return tasks.unionByName(fresh.select(*(c for c in fresh.columns if c in tasks.columns)), allowMissingColumns=True)


def updated_tasks(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """tasks (id, priority, work_status, attempts, ...) after a log of updates (id, ord, status, factor, notes): the last
    status, attempts plus one for each update to DOING or ATTEMPTED, priority times all factors, and notes merged, the last
    value of a key winning. Sums, products and maxima alone: a task with very many updates is no hot key but for its notes'
    distinct keys."""
    last = F.max(F.struct(F.col("status").isNotNull().alias("given"), "ord", "status"))
    sums = log.groupBy(F.col("id").alias("_id")).agg(last.alias("_last"), F.sum(F.col("status").isin("DOING", "ATTEMPTED").cast("int")).alias("_more"), F.product(F.coalesce("factor", F.lit(1.0))).alias("_factor"))
    each = log.select(F.col("id").alias("_nid"), "ord", F.explode("notes").alias("k", "v")).groupBy("_nid", "k").agg(F.max(F.struct("ord", "v")).alias("m"))
    notes = each.groupBy("_nid").agg(F.map_from_entries(F.collect_list(F.struct("k", "m.v"))).alias("_notes"))
    joined = tasks.join(sums, F.col("id") == F.col("_id"), "left").join(notes, F.col("id") == F.col("_nid"), "left")
    blank = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("worker_notes", blank), F.coalesce("_notes", blank)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    changed = {"work_status": F.coalesce("_last.status", "work_status"), "attempts": (F.col("attempts") + F.coalesce("_more", F.lit(0))).cast("int"), "priority": F.col("priority") * F.coalesce("_factor", F.lit(1.0)), "worker_notes": merged}
    return joined.withColumns(changed).select(*tasks.columns)


def outcomes(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """type, status, n of the updates that end an attempt: to ATTEMPTED, DONE or FAILED. Their sum is that of all attempts."""
    ended = log.filter(F.col("status").isin("ATTEMPTED", "DONE", "FAILED"))
    return ended.join(tasks.select("id", "type"), "id").groupBy("type", "status").agg(F.count("*").alias("n"))


def propagate_interest(edges: DataFrame, updates: DataFrame, gamma: float, objects: DataFrame) -> DataFrame:
    """path, interestingness of objects after updates (node, factor): times its own factors and factor * gamma^distance of
    each update of a descendant. edges: node, ancestor, distance."""
    own = updates.select(F.col("node").alias("path"), F.col("factor").cast("double").alias("f"))
    passed = edges.join(updates, "node").select(F.col("ancestor").alias("path"), (F.col("factor") * F.pow(F.lit(gamma), "distance")).alias("f"))
    factors = own.unionByName(passed).groupBy("path").agg(F.product("f").alias("f"))
    return objects.join(factors, "path", "left").select("path", (F.col("interestingness") * F.coalesce("f", F.lit(1.0))).alias("interestingness"))


def recovered(tasks: DataFrame) -> DataFrame:
    """After a restart nobody works on a task any more."""
    return tasks.withColumn("work_status", F.when(F.col("work_status") == "DOING", "ATTEMPTED").otherwise(F.col("work_status")))


def unique_paths(objects: DataFrame, path: str, id_col: str) -> DataFrame:
    """Paths that collide get a suffix -1, -2, ... in order of ids; the first keeps its own. Places are running counts over
    ranges, so a path that very many objects share is no hot key."""
    placed = running_sums(objects, [path], [id_col])
    return placed.withColumn(path, F.when(F.col("_upto") > 1, F.concat_ws("-", path, (F.col("_upto") - 1).cast("string"))).otherwise(F.col(path))).drop("_upto")


def rolling_calls(calls: DataFrame, seconds: int = 600) -> DataFrame:
    """calls with n_window and mean_latency of the same procedure's calls in the seconds up to each call.

    Time is cut into spans of that many seconds, and a span's calls are also dealt to the next one as guests: all that a
    call looks back at lies in its own span or the one before. So a procedure's calls are spread over its spans.
    """
    span = F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).cast("long")
    dealt = calls.withColumn("_at", F.explode(F.array(F.struct(span.alias("span"), F.lit(False).alias("guest")), F.struct((span + 1).alias("span"), F.lit(True).alias("guest")))))
    w = Window.partitionBy("procedure", "_at.span").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    return dealt.withColumns({"n_window": F.count("*").over(w), "mean_latency": F.avg("latency").over(w)}).filter(~F.col("_at.guest")).drop("_at")


def window_calls(calls: DataFrame, seconds: int = 600) -> DataFrame:
    """procedure, window start, n, rate by second, mean, p50 and p95 latency in windows that follow one another."""
    by = calls.groupBy("procedure", F.window("ts", f"{seconds} seconds").alias("w"))
    out = by.agg(F.count("*").alias("n"), F.avg("latency").alias("mean"), F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"))
    return out.select("procedure", F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("per_second"), "mean", "p50", "p95")


def last_seen(calls: DataFrame) -> DataFrame:
    return calls.groupBy("client").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def deltas(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Change of a running value since the snapshot before, by hour."""
    w = Window.partitionBy(key).orderBy(order)
    hours = (F.unix_micros(order) - F.unix_micros(F.lag(order).over(w))) / 3.6e9
    return snapshots.withColumn("per_hour", F.when(hours > 0, (F.col(value) - F.lag(value).over(w)) / hours))
