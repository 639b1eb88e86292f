"""Operator 8: a quality classifier by co-training (Blum and Mitchell 1998).

Two logistic models see a document from two sides that say little about each other: its text (hashed words and a few
measures of their form) and its metadata (language, source, size, layout). Both start from the same labelled documents.
In each round both score all unlabelled documents, and each hands the ones it is surest of, with its verdict as a label,
to the other; a document handed over once isn't again. What sure means is measured: a view hands over a class from the
score on beyond which that class is right in SURE of the calibration documents. In the end each view's logits are
calibrated on labelled documents that nothing was fitted to, and so is how much each tells next to the other; both together
score every document.

Only what is fitted to is bounded: LABELLED labelled documents, the first in order of a hash, and EXCHANGED pseudo-labels
of each class from each view in each round, the surest of all documents. Their hashed features come to the driver, at most
2 ** TEXT_BITS numbers each, never their texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_SENT, map_rows, release, settle, slices, table, unsettle

#: Labelled documents that the models are fitted to or calibrated on, at most.
LABELLED = 6_000
#: One in so many of them is for calibration.
HELD = 4
#: Rounds, and pseudo-labels of each class that a view gives the other in each.
ROUNDS, EXCHANGED = 2, 250
#: Least share of right verdicts among a view's sure ones, and least calibration documents that it is measured on.
SURE, LEAST = 0.8, 8
#: Hashed features of words and of metadata.
TEXT_BITS, META_BITS = 14, 12
#: Documents are kept down to the combined score that this share of the good calibration documents reaches, or down to
#: AT_MOST if that is less: a good document lost costs more than a bad one kept.
KEEP, AT_MOST = 0.995, 0.35
#: Words whose bucket a worker remembers.
MEMO = 150_000

_SYMBOL = re.compile(rb"[#*$%&|<>{}\\^~=+_@]")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh32_intdigest

        b = xxh32_intdigest(word) % (1 << TEXT_BITS)
        if len(self) >= MEMO:
            self.clear()
        if len(word) < 64:
            self[word] = b
        return b


_buckets = _Buckets()

#: Measures of form, after the hashed words: each is a share or a logarithm, scaled to about 0 to 1.
FORMS = 9


def text_features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values. A wordless text has its measures alone."""
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(raw.lower().split())
    at = np.fromiter(map(_buckets.__getitem__, counts), np.int64, len(counts))
    tf = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = np.sqrt((tf * tf).sum()) or 1.0
    letters = max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = letters - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = letters - len(raw.translate(None, b"0123456789"))
    fives = set(map(hash, zip(words, words[1:], words[2:], words[3:], words[4:])))
    forms = [
        np.log1p(len(words)) / 10,
        min(2.0, sum(map(len, words)) / n / 8),
        min(1.0, 4 * len(_SYMBOL.findall(raw)) / letters),
        min(1.0, 2 * upper / letters),
        min(1.0, 4 * digits / letters),
        min(1.0, 8 * raw.count(b"!") / letters),
        min(1.0, 4 * sum(map(bytes.__eq__, words, words[1:])) / n),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(fives) / max(1, len(words) - 4) if len(words) > 4 else 0.0,
    ]
    idx = np.concatenate((at, (1 << TEXT_BITS) + np.arange(FORMS)))
    return idx, np.concatenate((tf / norm, np.array(forms) * 4))


def layout(raw: bytes, chars: int) -> dict[str, int]:
    """What can be told of a text's shape without reading it."""
    sizes = list(map(len, raw.split(b"\n")))
    return {"chars": chars, "bytes": len(raw), "lines": len(sizes), "longest": max(sizes), "blank": sizes.count(0)}


def meta_features(meta: dict, shape: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """One-hot: values, steps of numbers, and steps of the layout alone, by each text value and in pairs. Null is a value."""
    from xxhash import xxh32_intdigest

    steps = lambda x, k: int(log2(max(0.0, x) + 1) * k)
    plain, parts = [], []
    for k, v in sorted(meta.items()):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            v = f"~{steps(float(v), 2)}" if v == v else "nan"
        else:
            plain.append(f"{k}={v}")
        parts.append(f"{k}={v}")
    chars, lines, longest = shape["chars"], shape["lines"], shape["longest"]
    wide = chars / lines
    parts += [f"bytes={steps(100 * (shape['bytes'] / max(1, chars) - 1), 2)}", f"lines={steps(lines, 2)}", f"wide={steps(wide, 4)}", f"longest={steps(longest, 3)}", f"blank={steps(shape['blank'], 1)}"]
    parts += [f"chars={steps(chars, 1)}&lines={steps(lines, 1)}", f"wide={steps(wide, 2)}&longest={steps(longest, 2)}", *(f"{v}&wide={steps(wide, 3)}" for v in plain)]
    idx = np.fromiter((xxh32_intdigest(p) % (1 << META_BITS) for p in parts), np.int64, len(parts))
    return idx, np.full(len(parts), 1 / max(1, len(parts)) ** 0.5)


@dataclass
class Rows:
    """Sparse rows, one after another."""

    idx: list = field(default_factory=list)
    val: list = field(default_factory=list)

    def add(self, features: tuple[np.ndarray, np.ndarray]) -> None:
        self.idx.append(features[0])
        self.val.append(features[1])


class Logistic:
    """L2-regularised logistic regression over sparse rows, by gradient steps with momentum of a fixed number."""

    def __init__(self, width: int):
        self.w, self.b, self.scale, self.shift = np.zeros(width), 0.0, 1.0, 0.0

    def fit(self, rows: Rows, labels: np.ndarray, l2: float = 1e-4, steps: int = 150) -> Logistic:
        sizes = np.array([len(x) for x in rows.idx], np.int64)
        idx, val = np.concatenate(rows.idx).astype(np.int64), np.concatenate(rows.val)
        of = np.repeat(np.arange(len(sizes)), sizes)
        # Both classes weigh the same.
        y = labels.astype(np.float64)
        weight = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
        w, b, m, v, mb, vb = np.zeros_like(self.w), 0.0, np.zeros_like(self.w), np.zeros_like(self.w), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.bincount(of, val * w[idx], len(sizes)) + b
            e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            g, gb = np.bincount(idx, val * e[of], len(w)) + l2 * w / len(w) ** 0.5, e.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
            w = w - 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-6)
            b -= 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-6)
        self.w, self.b = w, b
        return self

    def raw(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.w[features[0]] @ features[1] + self.b)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Platt scaling with smoothed targets, by Newton steps."""
        good, bad = labels.sum(), len(labels) - labels.sum()
        y = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        a, c = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * logits + c, -40, 40)))
            r = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(r * logits * logits).sum() + 1e-3, (r * logits).sum()], [(r * logits).sum(), r.sum() + 1e-3]])
            d = np.linalg.solve(h, [((p - y) * logits).sum() + 1e-3 * (a - 1), (p - y).sum()])
            a, c = a - np.clip(d[0], -1, 1), c - np.clip(d[1], -1, 1)
        self.scale, self.shift = max(0.0, float(a)), float(c)

    def logit(self, features: tuple[np.ndarray, np.ndarray]) -> float:
        return float(np.clip(self.scale * self.raw(features) + self.shift, -30, 30))


class Views:
    """Both models, how their calibrated logits are combined, and the least score kept."""

    def __init__(self):
        self.text, self.meta = Logistic((1 << TEXT_BITS) + FORMS), Logistic(1 << META_BITS)
        self.weights, self.least = (1.0, 0.0, 0.0), 0.0
        self.handed: list[dict] = []  # of each round: labels that a view ("t", "m") was handed, by class

    def weigh(self, text: np.ndarray, meta: np.ndarray, labels: np.ndarray) -> None:
        """How much each view's calibrated logits tell next to the other's: logistic regression on both, by Newton steps,
        held near the text's alone where few documents say anything else."""
        x = np.stack((text, meta, np.ones(len(text))), 1)
        start = w = np.array([1.0, 0.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            r = np.maximum(p * (1 - p), 1e-6)
            h = (x * r[:, None]).T @ x + np.eye(3)
            w = w - np.clip(np.linalg.solve(h, x.T @ (p - labels) + (w - start)), -1, 1)
        self.weights = tuple(map(float, np.maximum(w, (0.0, 0.0, -np.inf))))

    def mixed(self, text, meta):
        """The combined logit of both views' logits."""
        a, b, c = self.weights
        return np.clip(a * text + b * meta + c, -30, 30)

    def combined(self, text: float, meta: float) -> float:
        return float(1 / (1 + np.exp(-self.mixed(text, meta))))


def edge(logits: np.ndarray, labels: np.ndarray, label: int) -> float | None:
    """The score from which on a view is sure of a class: the widest end of the calibration documents, up to half of them,
    in which the label's share is SURE (less a document on either side, as few say little). None if there is no such end."""
    order = np.argsort(-logits if label else logits, kind="stable")[: max(LEAST, len(logits) // 2)]
    size = np.arange(1, len(order) + 1)
    right = np.cumsum(labels[order] == label)
    sure = np.flatnonzero((right + 1 >= SURE * (size + 2)) & (size >= LEAST))
    return float(logits[order[sure[-1]]]) if len(sure) else None


def _pairs(found: list[tuple]) -> tuple[Rows, Rows]:
    text, meta = Rows(), Rows()
    for *_, t, m in found:
        text.add(t)
        meta.add(m)
    return text, meta


def _gathered(rows: Iterable) -> list[tuple]:
    """_id, _label and both views' features of rows of _features(), in order of the id, of equal ids the first by _tie. As
    arrays from the moment they come: Python's numbers would take the driver five times as much."""
    found, out = [], {}
    for r in rows:
        sides = ((np.array(r[i], np.int32), np.array(r[v], np.float64)) for i, v in (("ti", "tv"), ("mi", "mv")))
        found.append((r["_id"], r["_tie"], r["_label"], *sides))
    for i, _, *rest in sorted(found, key=lambda x: x[:2]):
        out.setdefault(i, (i, *rest))
    return list(out.values())


def _sides(text: str | None, meta: dict) -> tuple:
    raw = (text or "").encode()
    return text_features(raw), meta_features(meta, layout(raw, len(text or "")))


def _features(given: DataFrame) -> DataFrame:
    """_id, _label, _tie and both views' features (ti, tv, mi, mv) of rows _id, _label, _text, _meta."""
    kind = given.schema["_id"].dataType.simpleString()

    def make():
        def step(cols):
            for i, label, tie, text, meta in zip(*cols):
                (ti, tv), (mi, mv) = _sides(text, meta)
                yield i, label, tie, ti.astype(np.int32), tv, mi.astype(np.int32), mv

        return step

    rows = given.select("_id", "_label", F.xxhash64("_text").alias("_tie"), "_text", "_meta")
    return map_rows(rows, make, f"_id {kind}, _label int, _tie long, ti array<int>, tv array<double>, mi array<int>, mv array<double>", rows=2_000)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), label_col: str = "quality") -> Views | None:
    """Views from labels (id, 0 or 1; null ids and labels are left out, repeated ones vote), or None if a class has
    fewer than two documents to fit to. Of documents with the same id the first in order of a hash of the text counts."""
    votes = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    given = _given(docs, id_col, text_col, meta_cols)
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = votes.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi").orderBy(*order).limit(LABELLED).collect()
    if not chosen:
        return None
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def fetch(ids: list[tuple]) -> list:
        """Features of documents by id and label; the number of ids is bounded by LABELLED."""
        picked = F.broadcast(spark.createDataFrame(ids, f"_id {kind}, _label int"))
        found = _gathered(_features(given.join(picked, "_id")).toLocalIterator())
        release()
        return found

    own = fetch([(r["_id"], r["_label"]) for r in chosen])
    place = np.arange(len(own)) % HELD == 0
    y = np.array([label for _, label, *_ in own])
    fit = dict(zip("tm", _pairs([r for r, h in zip(own, place) if not h])))
    held = dict(zip("tm", _pairs([r for r, h in zip(own, place) if h])))
    del own, chosen
    fit_y, held_y = {"t": y[~place], "m": y[~place]}, y[place]
    if min(fit_y["t"].sum(), (1 - fit_y["t"]).sum()) < 2:
        return None
    views = Views()
    both = {"t": views.text, "m": views.meta}

    def refit() -> dict[str, np.ndarray]:
        """Both views anew; their calibrated logits of the calibration documents."""
        out = {}
        for k, v in both.items():
            v.fit(fit[k], fit_y[k])
            release()
            raw = np.array([v.raw(x) for x in zip(held[k].idx, held[k].val)])
            v.calibrate(raw, held_y)
            out[k] = np.clip(v.scale * raw + v.shift, -30, 30)
        return out

    # Texts never shuffle to leave the labelled out: few ids are sent to all tasks; of many, the scores are left out.
    known = settle(votes.select("_id"))
    few = known.count() <= MOST_SENT
    logits, taken = refit(), []
    for _ in range(ROUNDS):
        if few:
            scored = settle(_scores(given.join(F.broadcast(known), "_id", "left_anti"), views))
        else:
            scored = settle(_scores(given, views).join(known, "_id", "left_anti"))
        # At most 4 * ROUNDS * EXCHANGED ids were handed over before.
        fresh = scored.filter(F.col("_id").isNotNull()).join(F.broadcast(spark.createDataFrame(taken, f"_id {kind}")), "_id", "left_anti")
        counts, new = {}, {}
        for view, other in ("tm", "mt"):
            # The surest beyond the edge; ties stand in order of a hash.
            for label in (1, 0):
                least = edge(logits[view], held_y, label)
                sure = F.lit(False) if least is None else F.col(view) >= least if label else F.col(view) <= least
                best = fresh.filter(sure).groupBy("_id").agg(F.max(view).alias(view)).orderBy(F.desc(view) if label else F.asc(view), *order).limit(EXCHANGED).collect()
                for r in best:
                    if (r["_id"], other) not in new:
                        new[r["_id"], other] = label
                        counts[other, label] = counts.get((other, label), 0) + 1
        views.handed.append(counts)
        unsettle(scored)
        if not new:
            break
        features = {r[0]: r for r in fetch([(i, 0) for i in {i for i, _ in new}])}
        for (i, other), label in sorted(new.items(), key=str):
            more = _pairs([features[i]])["tm".index(other)]
            fit[other].idx += more.idx
            fit[other].val += more.val
            fit_y[other] = np.append(fit_y[other], label)
        taken += sorted({(i,) for i, _ in new}, key=str)
        logits = refit()
    unsettle(known)
    views.weigh(logits["t"], logits["m"], held_y)
    together = 1 / (1 + np.exp(-views.mixed(logits["t"], logits["m"])))
    good = np.sort(together[held_y > 0])
    views.least = float(min(AT_MOST, good[int((1 - KEEP) * len(good))])) if len(good) else 0.0
    return views


def _given(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*meta_cols).alias("_meta"))


def _batches(views: Views, text_at: int, meta_at: int, use):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sides = (_sides(t, m) for t, m in zip(part.column(text_at).to_pylist(), part.column(meta_at).to_pylist()))
                yield use(part, [(views.text.logit(t), views.meta.logit(m)) for t, m in sides])
        _buckets.clear()
        release()

    return run


def _scores(given: DataFrame, views: Views) -> DataFrame:
    """_id, t, m: both views' logits."""
    sent = given.sparkSession.sparkContext.broadcast(views)
    kind = given.schema["_id"].dataType.simpleString()

    def run(batches):
        def use(part, logits):
            return pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in logits], pa.float64()), pa.array([x for _, x in logits], pa.float64())], ["_id", "t", "m"])

        return _batches(sent.value, 1, 2, use)(batches)

    return given.select("_id", "_text", "_meta").mapInArrow(run, f"_id {kind}, t double, m double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), label_col: str = "quality") -> DataFrame:
    """doc_id, text_score, meta_score, score (probabilities of a good document), kept; a row for each row.

    Null texts and metadata are values like others. Repeated rows are scored alike, each giving a row. Texts of any length
    are read whole. Ties among the surest stand in order of a hash of the id. Without labels of both classes every score is
    0.5 and every document is kept. An empty table gives an empty one. Other columns of docs, whatever their names, play no
    part.
    """
    views = train(docs, labels, id_col, text_col, meta_cols, label_col)
    own = F.col(id_col)
    if views is None:
        half = F.lit(0.5)
        return docs.select(own, half.alias("text_score"), half.alias("meta_score"), half.alias("score"), F.lit(True).alias("kept"))
    scored = _scores(_given(docs, id_col, text_col, meta_cols), views)
    chance = lambda c: 1 / (1 + F.exp(-c))
    a, b, c = views.weights
    score = chance(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("t") + b * F.col("m") + c)))
    return scored.select(F.col("_id").alias(id_col), chance(F.col("t")).alias("text_score"), chance(F.col("m")).alias("meta_score"), score.alias("score"), (score >= views.least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), label_col: str = "quality") -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns, in one pass and without a join."""
    views = train(docs, labels, id_col, text_col, meta_cols, label_col)
    if views is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(views)
    columns, names = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)  # clashing names can't meet
    text, meta = names[columns.index(text_col)], [F.col(names[columns.index(c)]).alias(c) for c in meta_cols]
    whole = plain.select(*names, F.col(text).alias("_text"), F.struct(*meta).alias("_meta"))

    def run(batches):
        v, n = sent.value, len(names)

        def use(part, logits):
            mask = pa.array([v.combined(t, m) >= v.least for t, m in logits], pa.bool_())
            return part.select(list(range(n))).filter(mask)

        return _batches(v, n, n + 1, use)(batches)

    return whole.mapInArrow(run, plain.schema).toDF(*columns)


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
