import collections
import itertools
import re

import corpus_pipeline
import sentencepiece
from tessera.llm import cotraining, mixing, pieces, rules, simhash


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def firsts(texts):
    """The smallest id of each group of texts whose sets of five-word shingles are 0.8 alike, by comparing all pairs."""
    low = {i: words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in low.items()}
    up = {i: i for i in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {find(i) for i in sets}


def test_stages(spark, sf):
    """Each stage against its operator's verdicts or, from the near-duplicates on, against a version without Spark."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    whole, now, seen = docs.columns, docs, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == whole, name
        seen.append(now)
    ids = [collections.Counter(r["doc_id"] for r in df.select("doc_id").collect()) for df in seen]
    good = [r["doc_id"] for r in labels.filter("quality = 1").collect()]
    assert sum(i in ids[1] for i in good) >= 0.97 * len(good)
    assert set(ids[1]) == {r["doc_id"] for r in cotraining.classify(docs, labels).filter("kept").collect()}
    assert set(ids[2]) == {r["doc_id"] for r in rules.judge(seen[1]).filter("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert set(ids[3]) == firsts(texts) and max(ids[3].values()) == 1
    # The mix: sources to targets by resharing, documents in order of their keys up to the budget, the last one whole.
    rows = {r["doc_id"]: (r["source"], len(words(r["text"])), r["text"]) for r in seen[3].collect()}
    taken = {r["doc_id"]: (r["taken"], r["source_size"], r["target"]) for r in mixing.mix(seen[3]).collect()}
    for source in {x[0] for x in rows.values()}:
        own = [i for i, x in rows.items() if x[0] == source]
        size, target = taken[own[0]][1:]
        assert size == sum(rows[i][1] for i in own) and abs(sum(taken[i][0] for i in own) - target) < 1
    for i, (_, size, _) in rows.items():
        assert ids[4][i] == (-(-taken[i][0] // size) if size else 1)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    want = collections.Counter((i, tuple(sp.encode(rows[i][2] or "", add_eos=True))) for i in ids[4].elements())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in last) == want
    for r in last:
        assert r["same"] == (sp.decode(r["ids"]) == (rows[r["doc_id"]][2] or ""))


def test_mixing_stage_follows_the_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixing.repeated(docs).groupBy("doc_id").count().collect()}
    for i, (size, t) in taken.items():
        assert copies.get(i, 0) == -(-t // size) if size else copies[i] == 1


def test_run_of_an_empty_corpus(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash.REACH > 0
