"""Operator 9: class-based n-gram scores of whole texts (Brown et al. 1992; exchange clustering after Kneser and Ney,
distributed as by Uszkoreit and Brants 2008).

A token's probability is that of its class after the class before, times that of the token within its class. Every word
of the training texts chooses its class by the exchange criterion, the likelihood of class bigrams:

1. The ITEMS most frequent words one after another, over all their bigrams, until a round moves none.
2. The CORE most frequent ones, in ROUNDS passes: a pass counts, for each of them, the classes before and after it, and
   each then moves to its best class, given those of the others.
3. All other words, each by the classes of its own neighbours in the core. A word that rare doesn't change class bigrams
   by much, so its gain is to first order the log-likelihood of its neighbours' classes; a word without a neighbour in
   the core takes a class by its hash.

Texts are cut into words twice: to count these, and to write each text as its words' numbers in the core, with the words
outside beside them. All passes after that read numbers.

Classes and counts of the core go to all tasks; their size is bounded by CORE. Other words are at most one in CORE of all
tokens each: their occurrences shuffle on the word, where a sorted stream gives each word its class, and packed places
come back to groups of texts. Of a word's occurrences HELD are in memory at most, the rest in a file until its class is
known. Long words are known by a hash, so no frequent one stays out of the core.
"""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import chain, repeat
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, bounded, frequent, map_rows, release, settle, slices, table, unsettle

#: Words that are clustered one by one, words whose classes and counts all tasks are sent, and classes.
ITEMS, CORE, CLASSES = 1_024, 65_536, 48
#: Rounds of exchange over the ITEMS words at most, and passes over the CORE words.
SWEEPS, ROUNDS = 8, 2
#: Words longer than this are known by a hash.
LONG = 64
#: Distinct words, and bytes of texts with them, that a task holds before it passes their counts on; places, too.
HELD, HELD_BYTES = 300_000, 64_000_000
#: Core words whose neighbours' classes shuffle as one row.
BLOCK = 256
#: The end token, which no word can be.
END = b"\n"
#: An occurrence of a word outside the core: the group of its text and its place among the group's words outside; and what
#: comes back to the group: its class there, and how often the word stands in training texts; small where both numbers are.
SPOT, PLACE = np.dtype([("g", "<i8"), ("o", "<i4")]), np.dtype([("o", "<i4"), ("k", "u1"), ("c", "<i8")])
SMALL = np.dtype([("o", "<u2"), ("k", "u1"), ("c", "<u2")])


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case, A-Z alone, and the end token. White space is the six ASCII characters, as in WORD."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def short(word: bytes) -> bytes:
    """What a word is known by."""
    return word if len(word) <= LONG else b"\0" + md5(word).digest()


def is_held_out(c: Column) -> Column:
    """One in seven, by the crc32 of the id as text; a null id is for training."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """word (binary, short), c over all rows."""

    def make():
        held: Counter = Counter()
        size = 0

        def step(cols):
            nonlocal size
            for t in cols[0]:
                held.update(words_of(t))
                size += len(t or b"")
                if len(held) > HELD or size > HELD_BYTES:
                    yield from flush()

        def flush():
            nonlocal size
            words, counts = list(held), np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            size = 0
            for at in range(0, len(words), 100_000):
                part = [w if len(w) <= LONG else short(w) for w in words[at : at + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(counts[at : at + 100_000])], ["word", "c"])

        step.end = flush
        return step

    return map_rows(docs.select(F.col(text_col).cast("binary")), make, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Core:
    """The most frequent words, the most frequent first, with their counts and classes (k: none yet)."""

    def __init__(self, words: list[bytes], counts: list[int], k: int):
        self.words, self.counts, self.k = words, np.array(counts, np.int64), k
        self.of = np.full(len(words), k, np.int64)
        self.hashed = any(w[:1] == b"\0" for w in words)  # whether any may be a long word's hash
        #: How numbers are written; the largest stands for words outside.
        self.kind = np.dtype("<u2" if len(words) < 65_536 else "<u4")
        self._at: dict[bytes, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_at": None}

    def places(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for others."""
        if self._at is None:
            self._at = {w: i for i, w in enumerate(self.words)}
        get = self._at.get
        out = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        if self.hashed:
            for i in np.flatnonzero(out < 0).tolist():
                if len(words[i]) > LONG:
                    out[i] = get(short(words[i]), -1)
        return out

    def read(self, numbers: list[bytes]) -> np.ndarray:
        """Numbers as encoded() wrote them, one text after another; as many as there are words for others."""
        return np.minimum(np.frombuffer(b"".join(numbers), self.kind), len(self.words))


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Elements of data as binaries, each up to one of ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends * data.itemsize)).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def encoded(rows: DataFrame, core: Core) -> DataFrame:
    """Of rows (_row, _id, _train, _text) each text with its words' numbers in the core, and with its words outside, a line
    each, as no word has one. Texts that were together (a slice) are a group _g; _at is a text's place there, first that of
    its first word outside among the group's."""
    bounded(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(core)
    schema = f"_g long, _at int, _id {rows.schema['_id'].dataType.simpleString()}, _train boolean, numbers binary, first int, rare binary"
    out = arrow_schema(schema)

    def run(batches):
        c = sent.value
        for batch in batches:
            for part in slices(batch):
                texts = [words_of(t) for t in part.column(3).to_pylist()]
                size, flat = part.num_rows, list(chain.from_iterable(texts))
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, size))
                at = c.places(flat)
                gone = np.flatnonzero(at < 0)
                upto = np.concatenate(([0], np.searchsorted(gone, ends)))
                others = list(map(flat.__getitem__, gone.tolist()))
                cols = {"_g": pa.array(np.full(size, part.column(0)[0].as_py())), "_at": pa.array(np.arange(size)), "_id": part.column(1), "_train": part.column(2), "first": pa.array(upto[:-1])}
                cols["numbers"] = binaries(np.where(at < 0, np.iinfo(c.kind).max, at).astype(c.kind), ends)
                cols["rare"] = pa.array([b"\n".join(others[lo:hi]) for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) for f in out], schema=out)
        release()

    return rows.select("_row", "_id", "_train", "_text").mapInArrow(run, schema)


def _sequences(texts: DataFrame, core: Core, begin, each, end, schema: str) -> DataFrame:
    """begin() gives a state; each(state, own) takes the numbers of whole texts, an end token after each; end(state) gives rows."""

    def make():
        state = begin()

        def step(cols):
            each(state, core.value.read(cols[0]))
            return ()

        step.end = lambda: end(state)
        return step

    return map_rows(texts.select("numbers"), make, schema)


def item_bigrams(texts: DataFrame, core: Core, items: int) -> np.ndarray:
    """How often one of the first core words follows another, each text standing after an end token; a square matrix of
    at most ITEMS ** 2 cells, whatever the corpus."""
    sent = texts.sparkSession.sparkContext.broadcast(core)
    n = min(items, len(core.words))
    stop = core.words.index(END)

    def each(sums, own):
        own = np.concatenate(([stop], own))
        a, b = own[:-1], own[1:]
        both = (a < n) & (b < n)
        np.add.at(sums, a[both] * n + b[both], 1)

    def end(sums):
        at = np.flatnonzero(sums)
        return zip((at // n).tolist(), (at % n).tolist(), sums[at].tolist())

    cells = _sequences(texts, sent, lambda: np.zeros(n * n, np.int64), each, end, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((n, n))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["n"].to_numpy()
    return out


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = SWEEPS) -> np.ndarray:
    """The class of each item, from the counts of item bigrams (a square matrix)."""
    n = len(bigrams)
    classes = max(1, min(classes, n))
    frequency = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-frequency, kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    b = bigrams.astype(np.float64)
    pairs = member.T @ b @ member  # class bigrams
    after, before = b @ member, b.T @ member  # of each item: classes after it, classes before it
    out, into = b.sum(1), b.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            if frequency[w] == 0:
                continue
            own, self_n = of[w], b[w, w]
            a, p = after[w].copy(), before[w].copy()
            a[own] -= self_n
            p[own] -= self_n
            # Without w.
            pairs[own] -= a
            pairs[:, own] -= p
            pairs[own, own] -= self_n
            left, right = pairs.sum(1), pairs.sum(0)
            # Gain of each class from taking w: its row, its column, and the cell where both meet.
            rows, columns = _xlogx(pairs + a) - _xlogx(pairs), _xlogx(pairs + p[:, None]) - _xlogx(pairs)
            cell = np.diag(pairs)
            gain = rows.sum(1) - np.diag(rows) + columns.sum(0) - np.diag(columns) + _xlogx(cell + a + p + self_n) - _xlogx(cell)
            gain -= _xlogx(left + out[w]) - _xlogx(left) + _xlogx(right + into[w]) - _xlogx(right)
            to = int(np.argmax(gain))
            if gain[to] <= gain[own] + 1e-9:
                to = own
            pairs[to] += a
            pairs[:, to] += p
            pairs[to, to] += self_n
            if to != own:
                moved += 1
                of[w] = to
                after[:, own] -= b[:, w]
                after[:, to] += b[:, w]
                before[:, own] -= b[w]
                before[:, to] += b[w]
        if not moved:
            break
    return of


def neighbours(texts: DataFrame, core: Core) -> tuple[np.ndarray, np.ndarray]:
    """Of each core word, how often each class stands after it and before it; neighbours without a class don't count.
    Blocks of words are added up where they meet; 2 * CORE * CLASSES numbers come to the driver, whatever the corpus."""
    sent = texts.sparkSession.sparkContext.broadcast(core)
    n, k, stop = len(core.words), core.k, core.words.index(END)
    blocks = -(-n // BLOCK)

    def each(sums, own):
        own = np.concatenate(([stop], own))
        of = np.append(sent.value.of, k)[own]
        here = own < n
        after = here[:-1] & (of[1:] < k)
        np.add.at(sums, (own[:-1][after] * 2) * k + of[1:][after], 1)
        before = here[1:] & (of[:-1] < k)
        np.add.at(sums, (own[1:][before] * 2 + 1) * k + of[:-1][before], 1)

    def end(sums):
        for i, part in enumerate(sums.reshape(blocks, -1)):
            if len(at := np.flatnonzero(part)):
                yield i, at.astype(np.int32).tobytes() + part[at].tobytes()

    parts = _sequences(texts, sent, lambda: np.zeros(blocks * BLOCK * 2 * k, np.int64), each, end, "block int, sums binary")

    def cells(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        some = len(raw) // 12
        return np.frombuffer(raw, np.int32, some), np.frombuffer(raw[4 * some :], np.int64)

    def add():
        held: dict[int, np.ndarray] = {}

        def step(cols):
            for i, x in zip(*cols):
                at, sums = cells(x)
                held.setdefault(i, np.zeros(BLOCK * 2 * k, np.int64))[at] += sums
            return ()

        step.end = lambda: end(np.concatenate([held.get(i, np.zeros(BLOCK * 2 * k, np.int64)) for i in range(blocks)])) if held else ()
        return step

    out = np.zeros((blocks, BLOCK * 2 * k), np.int64)
    for r in map_rows(parts.repartition("block"), add, "block int, sums binary").collect():
        at, sums = cells(r["sums"])
        out[r["block"]][at] += sums
    out = out.reshape(-1, 2, k)[:n]
    return out[:, 0].astype(np.float64), out[:, 1].astype(np.float64)


def class_pairs(after: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Class bigrams of words that have a class, from what stands after each."""
    out = np.zeros((k, k))
    known = of < k
    np.add.at(out, of[known], after[known])
    return out


def refine(after: np.ndarray, before: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Each word's best class given those of the others, the most frequent words first, a block of them at a time."""
    of, pairs = of.copy(), class_pairs(after, of, k)
    for at in range(0, len(of), BLOCK):
        w = np.arange(at, min(at + BLOCK, len(of)))
        a, p, own = after[w], before[w], of[w]
        placed = own < k
        seat = np.where(placed, own, 0)
        left, right, out, into = pairs.sum(1), pairs.sum(0), a.sum(1), p.sum(1)
        f = _xlogx(pairs)
        gain = (_xlogx(pairs + a[:, None, :]) - f).sum(2) + (_xlogx(pairs.T + p[:, None, :]) - f.T).sum(2)
        gain -= _xlogx(left + out[:, None]) - _xlogx(left) + _xlogx(right + into[:, None]) - _xlogx(right)
        # What the word gives the class that it is in: the class with it, less the class without it.
        less = lambda x, y: np.maximum(x - y, 0)
        stay = (f[seat] - _xlogx(less(pairs[seat], a))).sum(1) + (f.T[seat] - _xlogx(less(pairs.T[seat], p))).sum(1)
        stay -= _xlogx(left[seat]) - _xlogx(less(left[seat], out)) + _xlogx(right[seat]) - _xlogx(less(right[seat], into))
        gain[np.arange(len(w))[placed], own[placed]] = stay[placed]
        to = gain.argmax(1)
        to = np.where(placed & (gain[np.arange(len(w)), to] <= stay + 1e-9), own, to)
        to = np.where(out + into > 0, to, np.where(placed, own, w % k))
        for i in np.flatnonzero(to != own):
            if placed[i]:
                pairs[own[i]] = less(pairs[own[i]], a[i])
                pairs[:, own[i]] = less(pairs[:, own[i]], p[i])
            pairs[to[i]] += a[i]
            pairs[:, to[i]] += p[i]
        of[w] = to
    return of


class ClassModel:
    """What tasks need: the core with its classes, the tables from which other words choose theirs, and sums."""

    def __init__(self, core: Core, pairs: np.ndarray, tokens: int, distinct: int):
        k = core.k
        self.core, self.tokens, self.base = core, tokens, log10(tokens + distinct + 1)
        self.logs = np.log10(core.counts + 1.0)
        # Of each class of a neighbour (the last: unknown) what it says for each class of the word.
        none = np.zeros((1, k))
        self.if_after = np.concatenate((np.log((pairs + 0.5) / (pairs.sum(1, keepdims=True) + 0.5 * k)).T, none))
        self.if_before = np.concatenate((np.log((pairs + 0.5) / (pairs.sum(0, keepdims=True) + 0.5 * k)), none))


def core_of(docs: DataFrame, text_col: str) -> tuple[Core, int, int]:
    """The most frequent words of all rows, without classes yet, and how many tokens and distinct ones there are."""
    counts = settle(word_counts(docs, text_col))
    top = frequent(counts, "c", CORE, "word").toArrow()
    found = dict(zip(top["word"].to_pylist(), top["c"].to_pylist()))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    if END not in found:
        found[END] = docs.count()
    unsettle(counts)
    words = sorted(found, key=lambda w: (-found[w], w))
    return Core(words, [found[w] for w in words], 1), sums["n"], sums["v"]


def train(texts: DataFrame, core: Core, tokens: int, distinct: int) -> ClassModel:
    """The model of encoded texts, classes of words outside the core aside."""
    first = exchange(item_bigrams(texts, core, ITEMS))
    core.k = int(first.max()) + 1
    core.of = np.concatenate((first, np.full(len(core.words) - len(first), core.k)))
    for _ in range(ROUNDS):
        after, before = neighbours(texts, core)
        core.of = refine(after, before, core.of, core.k)
    return ClassModel(core, class_pairs(after, core.of, core.k), tokens, distinct)


def occurrences(texts: DataFrame, model: ClassModel) -> DataFrame:
    """word, before, after, train, g, o: each word outside the core of encoded texts, with the classes beside it, its text's
    group and its place among the group's words outside."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    schema = "word binary, before short, after short, train boolean, g long, o int"
    out = arrow_schema(schema)

    def run(batches):
        core = sent.value.core
        n, stop, of = len(core.words), int(core.of[core.words.index(END)]), np.append(core.of, core.k).astype(np.int16)
        for batch in batches:
            for part in slices(batch):
                g, train, first = (part.column(x).to_numpy(zero_copy_only=False) for x in range(3))
                numbers = part.column(3).to_pylist()
                own = core.read(numbers)
                ends = np.cumsum(np.fromiter(map(len, numbers), np.int64, len(numbers))) // core.kind.itemsize
                seq, gone = of[own], np.flatnonzero(own == n)  # never the last of a text, which is the end token
                if not len(gone):
                    continue
                row, upto = np.searchsorted(ends, gone, "right"), np.searchsorted(gone, ends)
                begin = np.concatenate(([0], ends[:-1]))[row]
                o = first[row] + np.arange(len(gone)) - np.concatenate(([0], upto[:-1]))[row]
                before, after = np.where(gone > begin, seq[gone - 1], stop), seq[gone + 1]
                words = [w if len(w) <= LONG else short(w) for w in b"\n".join(filter(None, part.column(4).to_pylist())).split(b"\n")]
                for lo in range(0, len(words), 50_000):
                    cut = slice(lo, lo + 50_000)
                    cols = [pa.array(words[cut], pa.binary()), *(pa.array(x[cut]) for x in (before, after, train[row], g[row], o))]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, out)], schema=out)
        release()

    return texts.select("_g", "_train", "first", "numbers", "rare").mapInArrow(run, schema)


class Spots:
    """Occurrences of a word in the order they come: `most` of them in memory, about, the rest in a file."""

    def __init__(self, most: int):
        self.most, self.held, self.size, self.file = most, [], 0, None

    def add(self, spots: np.ndarray) -> None:
        self.held.append(spots)
        self.size += len(spots)
        if self.size > self.most:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115
            for x in self.held:
                self.file.write(x.tobytes())
            self.held, self.size = [], 0

    def take(self) -> Iterator[np.ndarray]:
        """All of them, in parts; then there are none."""
        if self.file:
            self.file.seek(0)
            while raw := self.file.read(self.most * SPOT.itemsize):
                yield np.frombuffer(raw, SPOT)
            self.file.close()
        yield from self.held
        self.__init__(self.most)


def rare_classes(rare: DataFrame, model: ClassModel) -> DataFrame:
    """word, class, c of each word of rare (word, before, after, train): its best class by the training texts, and how often
    it stands there. Words that are in none have c = 0 and the class that stands for unknown words. A word's rows come one
    after another and leave only sums behind. Where rare has g and o, too, rows without a word tell each group g in `small`
    (SMALL) and `places` (PLACE) what was found of its words, those that are in no training text aside."""
    sent = rare.sparkSession.sparkContext.broadcast(model)
    told = "o" in rare.columns
    schema = "word binary, class short, c long" + ", g long, small binary, places binary" * told
    out = arrow_schema(schema)

    def run(batches):
        m = sent.value
        k = m.core.k
        last, score, c, spots = None, np.zeros(k), 0, Spots(HELD)
        found, size = [], 0

        def best_of(words, scores, counts):
            best = scores.argmax(1)
            blind = np.flatnonzero((scores == 0).all(1))
            best[blind] = [zlib.crc32(words[i]) % k for i in blind.tolist()]
            return np.where(counts > 0, best, k)

        def row(**cols):
            size = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in out], schema=out)

        def tell(where, best, counts):
            nonlocal size
            some = counts > 0
            found.append((where["g"][some], where["o"][some], best[some], counts[some]))
            size += len(found[-1][0])
            if size > HELD:
                yield from flush()

        def flush():
            nonlocal size
            g, o, best, counts = (np.concatenate(x) for x in zip(*found))
            found.clear()
            size = 0
            order, little = np.argsort(g, kind="stable"), (o < 65_536) & (counts < 65_536)
            for name, kind, some in (("small", SMALL, order[little[order]]), ("places", PLACE, order[~little[order]])):
                places = np.empty(len(some), kind)
                places["o"], places["k"], places["c"] = o[some], best[some], counts[some]
                for lo in range(0, len(some), 100_000):
                    part = g[some[lo : lo + 100_000]]
                    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
                    yield row(g=part[ends - 1], **{name: binaries(places[lo : lo + 100_000], ends)})

        def finish():
            """The last word, whose rows are all there."""
            best = best_of([last], score[None], np.array([c]))
            yield row(word=[last], c=[c], **{"class": best})
            for part in spots.take():
                if c:
                    yield from tell(part, best.repeat(len(part)), np.full(len(part), c))

        for batch in batches:
            if not batch.num_rows:
                continue
            words, code = batch.column(0), batch.column(1).to_numpy()
            train = (code >> 16 & 1).astype(bool)
            new = np.concatenate(([True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
            starts = np.flatnonzero(new)
            before, after = (np.where(train, code >> x & 255, k) for x in (8, 0))
            scores = np.add.reduceat(m.if_before[before] + m.if_after[after], starts)
            counts = np.add.reduceat(train.astype(np.int64), starts)
            names = words.take(pa.array(starts)).to_pylist()
            where = np.empty(len(train) if told else 0, SPOT)
            if told:
                where["g"], where["o"] = batch.column(2).to_numpy(), code >> 17
            at = 0  # of the words the first that begins here and isn't the last
            if last == names[0]:
                score, c, at = score + scores[0], c + int(counts[0]), 1
                spots.add(where[: starts[1] if len(starts) > 1 else None])
                if len(names) == 1:
                    continue
            if last is not None:
                yield from finish()
            if at < len(names) - 1:
                own = slice(at, -1)
                best = best_of(names[own], scores[own], counts[own])
                yield row(word=names[own], c=counts[own], **{"class": best})
                if told:
                    each = np.diff(starts)[at:]
                    yield from tell(where[starts[at] : starts[-1]], best.repeat(each), counts[own].repeat(each))
            last, score, c = names[-1], scores[-1], int(counts[-1])
            spots.add(where[starts[-1] :])
        if last is not None:
            yield from finish()
        if found:
            yield from flush()
        release()

    # o, train, before and after as one number: a row for each occurrence is what shuffles most.
    code = (((F.col("o") if told else F.lit(0)).cast("long") * 2 + F.col("train").cast("int")) * 256 + F.col("before")) * 256 + F.col("after")
    ordered = rare.select("word", code.alias("code"), *["g"] * told).repartition("word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group (first column), which come one after another."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        g = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                if held and now != g[lo]:
                    yield pa.Table.from_batches(held)
                    held = []
                now = g[lo]
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def classed(texts: DataFrame, model: ClassModel) -> DataFrame:
    """Encoded texts with their tokens' classes, a byte each (seq), how many tokens there are, those known and the sum of
    log10(count + 1): as the core alone has it, words outside are unknown."""
    sent = texts.sparkSession.sparkContext.broadcast(model)
    schema = f"_g long, _at int, _id {texts.schema['_id'].dataType.simpleString()}, train boolean, n long, known long, logs double, seq binary"
    out = arrow_schema(schema)

    def run(batches):
        m = sent.value
        core = m.core
        of, logs, is_known = np.append(core.of, core.k).astype(np.uint8), np.append(m.logs, 0.0), np.append(core.counts > 0, False)
        for batch in batches:
            for part in slices(batch):
                numbers = part.column(4).to_pylist()
                own = core.read(numbers)
                ends = np.cumsum(np.fromiter(map(len, numbers), np.int64, len(numbers))) // core.kind.itemsize
                begins = np.concatenate(([0], ends[:-1]))
                cols = [*part.columns[:4], pa.array(ends - begins), pa.array(np.add.reduceat(is_known[own], begins, dtype=np.int64)), pa.array(np.add.reduceat(logs[own], begins)), binaries(of[own], ends)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, out)], schema=out)
        release()

    return texts.select("_g", "_at", "_id", "_train", "numbers").mapInArrow(run, schema)


def filled(texts: DataFrame, places: DataFrame, model: ClassModel) -> DataFrame:
    """_id, train, n, known, logs, seq of each encoded text: classed() with what is known of all words. places (g, small,
    places) are what rare_classes() tells groups; words that none tells of are unknown. A group's texts are at most a slice."""
    k, names = model.core.k, ["_id", "train", "n", "known", "logs", "seq"]
    both = classed(texts, model).unionByName(places.select(F.col("g").alias("_g"), "small", "places"), allowMissingColumns=True)
    schema = f"_id {texts.schema['_id'].dataType.simpleString()}, train boolean, n long, known long, logs double, seq binary"
    out = arrow_schema(schema)

    def run(batches):
        for group in groups(batches):
            rows = group.filter(pc.is_valid(group["seq"])).combine_chunks()
            n, known, logs = (rows[x].to_numpy() for x in ("n", "known", "logs"))
            ends, seq = np.cumsum(n), np.frombuffer(b"".join(rows["seq"].to_pylist()), np.uint8).copy()
            gone = np.flatnonzero(seq == k)
            row = np.searchsorted(ends, gone, "right")
            for name, kind in (("small", SMALL), ("places", PLACE)):
                at = np.frombuffer(b"".join(group[name].drop_null().to_pylist()), kind)
                o = at["o"]
                seq[gone[o]] = at["k"]
                known = known + np.bincount(row[o], minlength=len(n))
                logs = logs + np.bincount(row[o], np.log10(at["c"] + 1.0), len(n))
            cols = {"_id": rows["_id"], "train": rows["train"], "n": rows["n"], "known": pa.array(known), "logs": pa.array(logs), "seq": binaries(seq, ends)}
            yield pa.Table.from_pydict(cols).cast(out).combine_chunks().to_batches()[0]
        release()

    return both.repartition("_g").sortWithinPartitions("_g", "_at").select("_g", *names, "small", "places").mapInArrow(run, schema)


def moves(whole: DataFrame, stop: int, size: int) -> np.ndarray:
    """How often a class (the last: unknown words) follows another in training texts, each after an end token."""

    def make():
        sums = np.zeros(size * size, np.int64)

        def step(cols):
            for seq in cols[0]:
                own = np.frombuffer(seq, np.uint8).astype(np.int64)
                np.add.at(sums, np.concatenate(([stop], own[:-1])) * size + own, 1)
            return ()

        step.end = lambda: [(i, int(sums[i])) for i in np.flatnonzero(sums).tolist()]
        return step

    out = np.zeros(size * size)
    for r in map_rows(whole.filter("train").select("seq"), make, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # size ** 2 rows at most
        out[r["cell"]] = r["n"]
    return out.reshape(size, size)


def log_moves(pairs: np.ndarray, class_counts: np.ndarray, class_kinds: np.ndarray) -> np.ndarray:
    """log10 of the probability that a class follows another, Witten-Bell-smoothed by how frequent classes are. Unknown
    words are the last class: any class may have emitted one, each with what its smoothing leaves for unknown words, and
    nothing but classes' frequencies says what follows."""
    k = len(class_counts)
    known = pairs[:k, :k]
    total = known.sum(0)
    lower = (total + 1) / (total.sum() + k)
    row, kinds = known.sum(1, keepdims=True), (known > 0).sum(1, keepdims=True)
    p = np.where(row > 0, (known + kinds * lower) / np.maximum(row + kinds, 1), lower)
    p = np.concatenate((p, lower[None]))
    unknown = p @ (1 / (class_counts + class_kinds + 1))
    return np.log10(np.concatenate((p, unknown[:, None]), axis=1))


class Scored:
    """Texts with their words' classes, and all that scores them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        held = is_held_out(F.col(id_col))
        core, tokens, distinct = core_of(docs.filter(~held), text_col)
        rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), (~held).alias("_train"), F.col(text_col).cast("binary").alias("_text"))
        texts = settle(encoded(rows, core))
        self.model = m = train(texts.filter("_train"), core, tokens, distinct)
        self.k = k = m.core.k
        found = settle(rare_classes(occurrences(texts, m), m))
        self.whole = settle(filled(texts, found.filter("word is null"), m))
        self.chosen = found.filter("word is not null").select("word", "class", "c")
        unsettle(texts)
        self.counts, self.kinds = np.zeros(k), np.zeros(k)
        np.add.at(self.counts, m.core.of, m.core.counts)
        np.add.at(self.kinds, m.core.of, (m.core.counts > 0).astype(float))
        for r in self.chosen.filter("c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # CLASSES rows
            self.counts[r["class"]] += r["c"]
            self.kinds[r["class"]] += r["v"]
        self.stop = int(m.core.of[m.core.words.index(END)])
        self.moves = log_moves(moves(self.whole, self.stop, k + 1), self.counts, self.kinds)
        self.emitted = np.append(np.log10(self.counts + self.kinds + 1), 0.0)

    def classes(self) -> DataFrame:
        """word (binary, short), class, c of every word of the training texts."""
        m = self.model.core
        core = self.whole.sparkSession.createDataFrame([(bytearray(w), int(o), int(c)) for w, o, c in zip(m.words, m.of, m.counts)], "word binary, class short, c long")
        return core.unionByName(self.chosen).filter("c > 0")


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities) of all rows, by the model
    of those that aren't held out.

    A null text is an empty one: the end token alone. A null id is for training. Each row gives one row; repeated rows
    count as often as they stand. Texts of any length are scored whole. Of words of equal frequency those first in order
    of their bytes come first; those at the core's edge come into it together or by their hash. Without training rows all
    words are unknown: N and V are 0. An empty table gives an empty one. Other columns of docs, whatever their names, play
    no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    s = Scored(docs, id_col, text_col)
    moved, emitted, stop, base, tokens = s.moves, s.emitted, s.stop, s.model.base, s.model.tokens

    def make():
        def step(cols):
            for i, train, n, known, logs, seq in zip(*cols):
                own = np.frombuffer(seq, np.uint8).astype(np.int64)
                yield i, not train, n, known, tokens, logs - n * base, logs + float((moved[np.concatenate(([stop], own[:-1])), own] - emitted[own]).sum())

        return step

    return map_rows(s.whole, make, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(table(spark, sf_dir, "documents"))
