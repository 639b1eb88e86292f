import math

from pyspark.sql import functions as F

from tessera.functions import programs, registry, text
from tessera.operators import iterations, records, selection, stats, store, tables
from tessera.operators.tables import numbered_rows
from tessera.sources import io
from tessera.streaming import calls


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert get(text.strip_comments(lit("a /* b\nc */ d // e\nf"))) == "a   d \nf"
    assert get(text.strip_c_comments(lit("/*@ keep */ /* go */ x //@ keep\n// go"))) == "/*@ keep */   x //@ keep\n"
    assert get(text.stripped(lit("a\n\n // x\n b"))) == "a\n b"
    assert get(text.split_identifier(lit("parseHTTPResponse_forX2'"))) == ["parse", "http", "response", "for"]
    assert get(text.first_fenced(lit("x\n```rs\nfn a\n```\n```\nb\n```"))) == "fn a" and get(text.first_fenced(lit("none"))) is None
    assert get(text.truncate(lit("abcdef"), 5)) == "ab..." and get(text.slugify(lit("  Hello, World! "))) == "hello-world"
    assert get(text.missing_spec_lines(lit("a\n b \nc"), lit("b\nx"))) == ["a", "c"]
    assert get(text.idea_comment(lit("x\n// Idea: sort a list\ny"))) == "sort a list" and get(text.without_idea(lit("x\n// Idea: s\ny"))) == "x\ny"
    assert get(text.run_label(lit("Ours:a/b.pkl"))) == "Ours" and get(text.run_label(lit("a/b.pkl"))) == "b"
    props = F.create_map(lit("a"), lit("1"), lit("b"), lit("false"))
    assert get(text.property_filter(props, ["a", "a=1"])) and not get(text.property_filter(props, ["b"])) and not get(text.property_filter(props, ["c"]))
    assert get(text.n_tokens(lit("abcde"))) == 2 and get(text.shorter_than(lit("abcde"), 3))
    assert get(text.annotations(lit("  invariant x > 0\nassert y"), "invariant")) == ["x > 0"]


def test_slugs_of_long_texts(spark):
    long = F.lit("Word " * 60 + "end.")
    whole, cut = spark.range(1).select(text.slugify(long), text.slugify(long, 60)).first()
    assert whole == "word-" * 60 + "end" and cut == "word-" * 11 + "word"


def test_wilson_of_nothing(spark):
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)


def test_examples_and_stats(spark):
    content = lambda s: bytearray(s.encode())
    objects = spark.createDataFrame([
        ("distil/1", "distil-example", content('{"prompt":"implement","arguments":{"idea":"i"},"response":"r","outcome":"success"}')),
        ("distil/2", "distil-example", content('{"prompt":"implement","arguments":{},"response":"r","outcome":"fail"}')),
        ("distil/3", "distil-example", content('{"prompt":"repair","arguments":{},"response":"r","outcome":"SUCCESS"}')),
        ("distil/4", "distil-example", content("not json")), ("other/5", "x", None), ("distil/6", "distil-example", bytearray(b'\xff\xfe{')),
        ("distil/7", "other", bytearray(b'{"prompt":"bad \xff byte","response":"r","outcome":"fail"}')),
    ], "path string, type string, content binary")
    found = io.examples(io.scan_prefix(objects, "distil/"), types=["distil-example"])
    assert [r["prompt"] for r in io.examples(objects, types=["other"]).collect()] == ["bad \ufffd byte"]
    parsed = objects.select(text.parsed(F.col("content"), "prompt string").alias("p")).filter("p.prompt IS NOT NULL")
    assert parsed.count() == 4 and objects.filter(text.is_success(F.lit("SUCCESS"))).count() == objects.count()
    assert found.count() == 3 and io.examples(objects, success_only=True).count() == 2
    counts = {(r["prompt"], r["outcome"], r["level"]): r["n"] for r in stats.grouping_counts(found, "prompt", "outcome").collect()}
    assert counts[(None, None, 3)] == 3 and counts[("implement", None, 1)] == 2


def test_sft_records(spark):
    kind = "prompt string, arguments map<string,string>, response string, outcome string"
    rows = spark.createDataFrame([("implement", {"idea": "i"}, "y", "success"), ("implement", {"idea": "j"}, "y", "fail"), ("idea", {}, "i", None), ("idea", {}, "j", None), ("generate", {}, "z", "success")], kind)
    systems = {"implement": "You write.", "idea": "You think."}
    kept = records.sft_records(rows, systems).collect()
    assert sorted(r["completion"][0]["content"] for r in kept) == ["i", "y"]
    assert [m["role"] for m in kept[0]["messages"]] == ["system", "user"]
    assert records.sft_records(rows, systems, success_only=False).count() == 3
    program = records.program_of(F.col("prompt"), F.col("arguments"), F.col("response"))
    repair = spark.createDataFrame([("repair", {"program": "a\nb\n"}, "@@a@@\n+ x", "success")], kind)
    assert repair.select(program.alias("p")).first()["p"] == "a\nx\nb\n"


def test_selection_properties(spark):
    rows = [(d, "k1" if d < 30 else "k2", "m", f"v{d % 7}", 1) for d in range(40)]
    features = spark.createDataFrame(rows, "doc long, kind string, metric string, value string, cnt long")
    docs = spark.createDataFrame([(d, "k1" if d < 30 else "k2") for d in range(40)] + [(99, "k3")], "doc long, kind string")
    picked = values(selection.top_surprisal(features, docs, 0.33))
    n = {k: sum(r[1] == k for r in picked) for k in ("k1", "k2", "k3")}
    assert n == {"k1": math.ceil(0.33 * 30), "k2": math.ceil(0.33 * 10), "k3": 1}
    assert selection.checkpoints(100)[-1] == 100 and min(selection.checkpoints(100)) >= 10 and selection.checkpoints(0) == []
    split = selection.split_by_program(features, F.col("doc") % 11, 0.2, F.xxhash64("doc"))
    both = split.groupBy(F.col("doc") % 11).agg(F.countDistinct("split").alias("n")).filter("n > 1")
    assert both.count() == 0 and split.filter("split = 'val'").count() > 0
    sub = selection.matched_subsamples(features, docs.withColumnRenamed("kind", "run"), 5, 20, "run")
    assert all(0 <= r["mean_entropy"] <= math.log2(5) for r in sub.collect())
    h = stats.entropy_bits(features, ["metric"]).first()
    assert 0 <= h["entropy"] <= math.log2(h["unique_values"]) + 1e-9


def test_rarefaction_curve_takes_all_programs(spark):
    rows = [(d, "m", f"v{d * k % 90}", 1) for d in range(300) for k in (1, 7)]
    features = spark.createDataFrame(rows, "doc long, metric string, value string, cnt long")
    got = {r["n"]: r["unique_values"] for r in selection.rarefaction_curve(features, -F.col("doc")).collect()}
    assert got == {n: len({v for d, _, v, _ in rows if d >= 300 - n}) for n in selection.checkpoints(300)} and max(got) == 300
    assert selection.rarefaction_curve(features.limit(0), F.col("doc")).count() == 0


def test_running_sums_over_ranges(spark):
    rows = [(g, k * 37 % 101, k % 4) for g in ("a", None, "b") for k in range(100 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, o int, x int").repartition(5)
    want, sums = [], {}
    for g, o, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        sums[g] = sums.get(g, 0) + x
        want.append((g, o, x, sums[g]))
    assert values(tables.running_sums(df, ["g"], ["o"], "x")) == sorted(want, key=repr)
    assert tables.running_sums(df.limit(0), ["g"], ["o"]).count() == 0
    got = {r["g"]: (r["q0"], r["q1"]) for r in stats.exact_percentiles(df, ["g"], "o", [0.5, 0.9]).collect()}
    for g in ("a", None, "b"):
        own = sorted(o for h, o, _ in rows if h == g)
        pick = lambda q, own=own: own[int(q * (len(own) - 1))] + (q * (len(own) - 1) % 1) * (own[min(len(own) - 1, int(q * (len(own) - 1)) + 1)] - own[int(q * (len(own) - 1))])
        assert all(abs(x - pick(q)) < 1e-9 for x, q in zip(got[g], (0.5, 0.9)))


def test_hot_values_change_no_surprisal(spark, monkeypatch):
    rows = [(d, "k" if d % 3 else None, "m", f"v{min(d * j % 17, 9)}", 1) for d in range(50) for j in (1, 2, 3)]
    features = spark.createDataFrame(rows, "doc long, kind string, metric string, value string, cnt long")
    want = values(stats.max_surprisal(features))
    monkeypatch.setattr(stats, "HOT", 3)
    assert values(stats.max_surprisal(features)) == want and len(want) == 50


def test_density_of_a_large_group(spark):
    df = spark.range(30_000).select(F.lit("g").alias("k"), (F.col("id") % 1000).alias("x"))
    (near,) = [r["density"] for r in stats.kde(df, ["k"], "x", [500.0], most=2_000).collect()]
    assert abs(near - 1e-3) < 1e-4
    assert stats.kde(df.limit(0), ["k"], "x", [1.0]).count() == 0


def test_index_percentile_weighted_order_and_shuffle(spark):
    one = spark.range(1).select(stats.index_percentile(F.array(*map(F.lit, [5, 1, 3, 2])), 0.5).alias("m"), stats.index_percentile(F.array(*map(F.lit, [5, 1])), 1.0).alias("x")).first()
    assert (one["m"], one["x"]) == (3, 5)
    ids = spark.range(400)
    first = [r["id"] for r in selection.shuffled(ids, "id", 3, 10).collect()]
    assert len(set(first)) == 10 and first == [r["id"] for r in selection.shuffled(ids, "id", 3).limit(10).collect()] != list(range(10))
    heavy = ids.withColumn("w", F.when(F.col("id") < 40, 100.0).otherwise(1.0)).orderBy(selection.weighted_order(F.col("w"), F.col("id"), 1)).limit(40).collect()
    assert sum(r["id"] < 40 for r in heavy) > 25


def test_lineage_doubles_and_ends_in_cycles(spark):
    chain = spark.range(1, 101).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    found = store.lineage(chain)
    assert found.count() == 5050 and found.filter("node = 100").count() == 100 and found.filter("node - ancestor <> distance").count() == 0
    ring = spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(0, 2), (7, 7), (8, None)], "node long, parent long")
    by_steps = store.lineage(ring, ring.select("node").distinct()).filter("node <> ancestor")
    assert values(store.lineage(ring)) == values(by_steps)


def test_store_updates(spark):
    tasks = spark.createDataFrame([("a", "x", 2.0, "NEW", 0, {"k": "1"}), ("b", "y", 1.0, "DONE", 3, None)], "id string, type string, priority double, work_status string, attempts int, worker_notes map<string,string>")
    log = spark.createDataFrame([("a", 1, "DOING", None, None), ("a", 2, "ATTEMPTED", 3.0, {"k": "2", "l": "3"}), ("a", 3, None, 0.5, {"l": "4"}), ("a", 4, "DONE", None, None)], "id string, ord int, status string, factor double, notes map<string,string>")
    after = {r["id"]: r for r in store.updated_tasks(tasks, log).collect()}
    assert (after["a"]["work_status"], after["a"]["attempts"], after["a"]["priority"], after["a"]["worker_notes"]) == ("DONE", 2, 3.0, {"k": "2", "l": "4"})
    assert (after["b"]["work_status"], after["b"]["attempts"], after["b"]["worker_notes"]) == ("DONE", 3, {})
    assert values(store.outcomes(tasks, log)) == [("x", "ATTEMPTED", 1), ("x", "DONE", 1)]
    new = spark.createDataFrame([("a", "x", 1), ("c", "x", 2), ("c", "y", 3), (None, "x", 4)], "id string, type string, ord int")
    more = store.added_tasks(tasks, new).collect()
    assert len({r["id"] for r in more}) == 6 and {"a", "b", "c"} <= {r["id"] for r in more} and sum(r["work_status"] == "NEW" for r in more) == 5
    edges = spark.createDataFrame([("a", "b", 1)], "node string, ancestor string, distance int")
    ups = spark.createDataFrame([("a", 4.0)], "node string, factor double")
    own = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 1.0)], "node string, priority double")
    assert values(store.propagate_priority(edges, ups, 0.5, own).select("node", "priority")) == [("a", 1.0), ("b", 3.0), ("c", 1.0)]
    objects = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 1.0)], "path string, interestingness double")
    assert values(store.propagate_interest(edges, ups, 0.5, objects)) == [("a", 4.0), ("b", 6.0), ("c", 1.0)]


def test_iterations(spark):
    found = iterations.discover(["b__claude_it", "x-seed-1", "x_it10", "x_it2", "x-seed-2"], "-seed-", r"_it(\d+)$")
    assert found == [(0, ["x-seed-1", "x-seed-2"]), (1, ["x_it2"]), (2, ["x_it10"])]
    for paths in (["x_it1"], ["x-seed-1"]):
        try:
            iterations.discover(paths, "-seed-", r"_it(\d+)$")
            raise AssertionError("no error")
        except ValueError:
            pass
    sums = spark.createDataFrame([(0, "t", "DONE", 2), (0, "t", "DONE", 3)], "iteration int, type string, status string, n long")
    assert values(iterations.outcome_sums(sums)) == [(0, "t", "DONE", 5)]
    rows = spark.range(900).select((F.col("id") % 2).cast("int").alias("iteration"), F.lit("m").alias("metric"), (F.col("id") % 100).cast("double").alias("x"), F.lit(2).cast("long").alias("cnt"))
    curve = iterations.ridges(rows, points=20).collect()
    assert len(curve) == 40 and all(0 < r["density"] < 0.05 for r in curve)


def test_registry_and_task_records(spark):
    assert set(registry.LANGUAGES) == {"dafny", "verus", "framac"} and registry.tasks_by_prompt()["repair"].name == "repair"
    for add, own in ((registry.add_language, registry.LANGUAGES["dafny"]), (registry.add_task, registry.TASKS["repair"])):
        try:
            add(own)
            raise AssertionError("no error")
        except ValueError:
            pass
    kind = "prompt string, arguments map<string,string>, response string, outcome string"
    rows = spark.createDataFrame([("repair", {"program": "p", "notes": "n"}, "d", "success"), ("repair", {"program": "p"}, "d", "fail"), ("unknown", {"a": "b"}, "d", "success"), ("implement", {}, "d", "success"), ("implement", {"idea": "i"}, None, "success")], kind)
    (r,) = records.task_records(rows).collect()
    assert r["messages"][1]["content"] == "## program\np\n\n## notes\nn" and records.task_records(rows, success_only=False).count() == 2
    named = spark.createDataFrame([("t1", "repair", 2), ("t2", "repair", 1)], "task string, prompt_type string, ord int")
    assert {x["task"] for x in records.tasks_of(rows, named).collect()} == {"t2"}
    assert "compute_diff" in registry.register_functions(spark)
    assert spark.sql("SELECT apply_diff('a\n', compute_diff('a\n', 'b\n')) AS x").first()["x"] == "b\n"
    feature = spark.createDataFrame([("method M() {\n}\n",)], "s string").select(F.size(registry.LANGUAGES["dafny"].features(F.col("s"))).alias("n"), registry.LANGUAGES["framac"].stripped(F.lit("/* a */ b")).alias("b")).first()
    assert feature["n"] > 0 and feature["b"].strip() == "b"


def test_more_sources_and_sinks(spark, tmp_path):
    objects = spark.createDataFrame([("dataset/a.dfy", "p", bytearray(b"// c\nmethod M() {\n  assert true;\n}\n\xff"), {"status": "success", "parent_idea": "i"}), ("dataset/b.dfy", "p", None, {"status": "failed"}), ("other", "p", bytearray(b"x"), {"status": "success"})], "path string, type string, content binary, properties map<string,string>")
    (r,) = io.dataset_records(objects).collect()
    assert r["source"] == "method M() {\n  assert true;\n}\n\ufffd" and r["methods"][0]["assertions"] == 1
    io.write_dataset(io.dataset_records(objects), "d", str(tmp_path / "set"))
    assert spark.read.json(str(tmp_path / "set/about")).first()["n_programs"] == 1 and spark.read.json(str(tmp_path / "set/programs")).first()["path"] == "dataset/a.dfy"
    assert [x["id"] for x in io.hub_records(objects).collect()] == ["a", "other"] and io.hub_records(objects).filter("id = 'a'").first()["content"].endswith("\ufffd")
    assert [x["path"] for x in io.verified_programs(objects, "p", ["success"]).collect()] == ["dataset/a.dfy"]
    io.write_results(objects.select("path"), {"model": "m"}, str(tmp_path / "res"))
    assert spark.read.json(str(tmp_path / "res/metadata")).first()["metadata"]["model"] == "m" and spark.read.json(str(tmp_path / "res/results")).count() == 3
    io.write_examples(objects.select("type", F.col("path").alias("o")), "ex", str(tmp_path / "ex"), "o")
    assert sorted(x["path"] for x in spark.read.parquet(str(tmp_path / "ex")).collect()) == ["ex_000000", "ex_000001", "ex_000002"]
    (tmp_path / "bench.jsonl").write_text('{"task_id":"1","task":"t","ground_truth":"g"}\n{"task_id":"2"}\n')
    assert io.benchmark(spark, str(tmp_path / "bench.jsonl")).count() == 1
    files = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "u")], "name string, source string")
    done = spark.createDataFrame([("a", "SUCCESS"), ("b", "fail")], "name string, outcome string")
    assert [x["name"] for x in io.unverified(files, done).collect()] == ["b"]
    corpus = io.annotated_corpus(files, spark.createDataFrame([("a", "h")], "name string, source string"), spark.createDataFrame([("a", 100), ("b", 50)], "name string, percent int"))
    assert {(x["name"], x["source"], x["status"]) for x in corpus.collect()} == {("a", "h\ns", "success"), ("b", "t", "failed"), ("c", "u", "unknown")}
    own = files.withColumn("language", F.lit("dafny"))
    assert io.pooled({"x": [own, own], "y": [own]}).groupBy("label").count().orderBy("label").collect()[0]["count"] == 6
    try:
        io.pooled({"x": [own, files.withColumn("language", F.lit("verus"))]})
        raise AssertionError("no error")
    except ValueError:
        pass


def test_spec_counts(spark):
    source = "// c\nmethod A()\n  ensures true\n{\n  assert true;\n  invariant x\n}\nlemma B()\n{\n}\n"
    counts = stats.spec_counts(F.lit(source))
    r = spark.range(1).select(*(c.alias(k) for k, c in counts.items())).first()
    assert (r["code_lines"], r["with_ensures"], r["asserts"], r["invariants"]) == (9, 1, 1, 1)


def test_more_udf_columns(spark):
    source = "lemma L(x: int)\n  ensures x == x\n{\n  assert x == x;\n}\n"
    df = spark.createDataFrame([(source,)], "s string")
    r = df.select(
        programs.last_fenced_column(F.lit("```py\nx\n```")).alias("a"), programs.template_column(F.lit("x == y")).alias("b"), programs.nontrivial_column(F.col("s")).alias("c"),
        programs.inserted_column(F.col("s"), F.lit("L"), F.lit("  new;")).alias("d"), programs.method_hints_removed_column(F.col("s"), F.lit(1)).alias("e"), programs.lemmas_column(F.col("s")).alias("f"),
    ).first()
    assert r["a"] == "x\n" and r["b"] == "* == *" and not r["c"] and "  new;\n}" in r["d"] and r["e"]["removed"] == 1 and r["f"][0]["name"] == "L"
    hollowed = df.select(programs.hollow_column(F.col("s"), F.lit("L")).alias("h"))
    assert hollowed.select(programs.lemma_diff_column(F.col("h"), F.lit("  assert true;"), F.lit("L")).alias("x")).first()["x"].endswith("+   assert true;")


def test_checkpoint_and_files(spark, tmp_path):
    tasks = spark.createDataFrame([("t", "x", [], {}, ["p", "gone"], 2.0, "DOING", 1, {})], io.SCHEMAS["tasks"])
    objects = spark.createDataFrame([("p", "x", [], bytearray(b"c"), {"status": "success"}, 3.0)], io.SCHEMAS["objects"])
    outcomes = spark.createDataFrame([], io.SCHEMAS["outcomes"])
    io.write_checkpoint({"tasks": tasks, "objects": objects, "outcomes": outcomes}, str(tmp_path / "ck"))
    back = io.read_checkpoint(spark, str(tmp_path / "ck"))
    assert back["tasks"].first()["work_status"] == "ATTEMPTED"
    assert store.effective_priority(back["tasks"], back["objects"]).first()["effective"] == 6.0
    v = [b"one", b"one two", b"three"]
    kept = spark.createDataFrame([("a/b.dfy", bytearray(v[2]), [bytearray(programs.compute_patch(v[k + 1], v[k])) for k in range(2)])], "path string, content binary, history array<binary>")
    files = io.materialized(kept)
    assert values(files.select("path", F.decode("content", "UTF-8"))) == [("a/b.dfy", "three"), ("a/b.dfy.v1", "one"), ("a/b.dfy.v2", "one two")]
    assert io.write_files(files, str(tmp_path / "out")) == 3 and (tmp_path / "out/a/b.dfy").read_bytes() == b"three"
    assert io.program_files(spark, str(tmp_path / "out")).first()["name"] == "b"
    assert io.programs_in(spark, str(tmp_path / "out/a")).select("language").first()[0] == "dafny"
    numbered = numbered_rows(spark.range(50).withColumn("o", -F.col("id")), "o")
    assert values(numbered.select("_n", "id")) == sorted(((49 - k, k) for k in range(50)), key=repr)


def test_lineage_of_a_long_chain(spark):
    parents = spark.range(1, 67).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    found = store.lineage(parents, spark.range(66, 67).select(F.col("id").alias("node")))
    assert values(found.select("ancestor", "distance")) == sorted(((66 - k, k) for k in range(1, 67)), key=repr)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"repo":"r","readme":"x"}\n\n{"repo":"s"}\n')
    assert io.jsonl(spark, str(tmp_path / "a.jsonl"), "repo string, readme string", ["repo", "readme"]).count() == 1
    (tmp_path / "b.json").write_text('[{"t":"```rs\\nfn\\n```"},{"t":"none"}]')
    rows = io.json_array(spark, str(tmp_path / "b.json"), "t string, status string")
    assert [r["code"] for r in io.converted(rows, "t", ["success"]).collect()] == ["fn"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("p", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 50, 5)], "procedure string, t string, latency double").select("procedure", F.to_timestamp("t").alias("ts"), "latency")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    calls.run(calls.rolling(stream, slide="600 seconds", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["start"]: r["n"] for r in store.window_calls(rows).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_udf_columns(spark):
    source = "lemma L(x: int)\n  ensures x == x\n{\n  assert x == x;\n}\n"
    df = spark.createDataFrame([(source,), (None,)], "s string")
    assert df.select(programs.methods_column("s").alias("m")).filter("m IS NOT NULL").first()["m"][0]["name"] == "L"
    assert df.select(F.explode(programs.features_column("s")).alias("f")).filter("f.metric = 'lemma_body_size'").first()["f"]["value"] == "1"
    assert df.select(programs.hints_removed_column("s", F.lit(1)).alias("h")).first()["h"]["removed"] == 1
    hollowed = df.filter("s IS NOT NULL").select(programs.hollow_column("s", F.lit("L")).alias("h"))
    assert programs.lemmas(hollowed.first()["h"])[0]["trivial"]
