"""Operator 1: encoding and decoding with a merge-type piece model, exact and by backtracking.

The encoder never replays merges over a text. It walks the text left to right over the matches that an
Aho-Corasick automaton of the vocabulary finds, tries the longest piece first, and takes a piece only if it
can stand right of the piece before it: un-merging both pieces in reverse order of their ranks shows whether
merging would have joined anything across the boundary. Positions from which no piece fits are marked in a
bitfield and never tried again, so the walk is linear in the text.

Where the vocabulary proves that no piece crosses a boundary (before a space run, or around a newline that is
in no piece), the text is cut there first and the parts' encodings are kept in a bounded memo. If a vocabulary
doesn't prove it, the whole text is one part. The signs that a new part ends in are taken off first, where no
piece has the last letter and the first sign side by side, so words before full stops and commas are looked up.

Of the matches only the longest at a position is looked up; the shorter ones there are the pieces it starts with. In parts
of up to WINDOW characters the automaton gives them leftmost and longest, and starts anew where a shorter one was taken.

Memory: a text is cut into segments of about SEGMENT characters at such boundaries, and a longer part without one is
walked over matches of WINDOW characters at a time. What grows with a text is its ids, 4 bytes each, and a bit a
character.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, map_rows, table

SPACE = "▁"
#: Parts of a text kept by each Python worker with their ids, and as many of those before them. About 50 MB in all.
MEMO = 100_000
#: Signs that parts end in, kept with their ids; these start anew beyond that. A few MB.
ENDS = 20_000
#: Longer parts are never kept.
MEMO_CHARS = 48
#: Places for pairs of pieces whose compatibility a worker remembers, 8 bytes each: a prime. A pair takes the place of
#: the one that stood there.
PAIRS = 1_048_573
#: Characters of a text that are cut into parts at a time.
SEGMENT = 262_144
#: Characters of a part for which matches are held at a time, and how many such windows: a way back beyond them finds its
#: matches anew. The automaton copies a shorter part each time it starts on it.
WINDOW, WINDOWS = 1_024, 4


class _Matches:
    """The longest piece that starts at each position of a text."""

    def __init__(self, model: PieceModel, text: str):
        self.model, self.text, self.held = model, text, {}

    def __getitem__(self, at: int) -> int:
        k = at // WINDOW
        own = self.held.get(k)
        if own is None:
            if len(self.held) >= WINDOWS:
                del self.held[min(self.held)]
            own = self.held[k] = self.model.matches(self.text[k * WINDOW : (k + 1) * WINDOW + self.model.longest])
        return own[at - k * WINDOW]


class PieceModel:
    """A merge-type (BPE) model file with byte fallback and no text normalisation of its own."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only merge-type models without normalisation are encoded by this operator")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        # A merge comes the sooner the higher its piece's score; equal scores are the same rank, leftmost first.
        scores = sorted({proto.pieces[i].score for i in self.ids.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = {i: order[proto.pieces[i].score] for i in self.ids.values()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unk, self.end_id = proto.trainer_spec.unk_id, proto.trainer_spec.eos_id
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.size = [len(p) for p in self.pieces]
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.automaton.add_word(piece, i)
            last: list[tuple[int, int]] = []
            if len(piece) > 1 and self.merge(piece, last) == [i]:  # else merging never makes this piece
                self.automaton.add_word(piece, i)
                self.split[i] = last[-1]
                self.pair[last[-1]] = i
        self.automaton.make_automaton()
        ranks: dict[int, set[int]] = {}
        for i in self.split:
            ranks.setdefault(self.rank[i], set()).add(i)
        self.tied = {i for own in ranks.values() if len(own) > 1 for i in own}
        for i, (a, b) in self.split.items():  # un-merging in order of rank needs parts older than the whole
            if i not in self.tied and any(x in self.split and self.rank[x] >= self.rank[i] for x in (a, b)):
                self.tied.add(i)
        self.longest = max(map(len, self.ids), default=1)
        # Of each piece the longest other one that it starts with: what else matches where it does. -1: none.
        matched = {p: i for p, i in self.ids.items() if len(p) == 1 or i in self.split}
        self.shorter = [-1] * len(self.pieces)
        for piece, i in matched.items():
            self.shorter[i] = next((matched[own] for k in range(len(piece) - 1, 0, -1) if (own := piece[:k]) in matched), -1)
        self.cuts_spaces = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.cuts_lines = all("\n" not in p for p in self.ids)
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # pairs of characters within pieces
        self.signs = "".join(p for p in self.ids if len(p) == 1 and not p.isalnum() and p != SPACE)
        self.cuts_all = self.prefix and self.cuts_spaces and self.cuts_lines and SPACE in self.ids
        self.fits = array("q", [-1]) * PAIRS  # the number of a compatible pair, -2 less that of another; -1: none yet
        self.memo = _Memo(self)
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        self.names = list(map(str, range(len(self.pieces))))
        self.text_of = {str(i): p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.text_of |= {str(i): "" for i, t in enumerate(self.types) if t == 3}
        # A byte below 128 is a whole character wherever it stands.
        self.text_of |= {str(i): chr(b) for b, i in self.bytes.items() if b < 128}

    def merge(self, text: str, log: list | None = None) -> list[int]:
        """Merging by its definition, for pieces and pairs of pieces only: of all neighbours whose joint text is
        a piece, the best-scored and leftmost are joined, until there are none."""
        parts = list(text)
        while True:
            best = min(((self.rank[j], k) for k in range(len(parts) - 1) if (j := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return [self.ids[p] for p in parts]
            k = best[1]
            if log is not None and parts[k] in self.ids and parts[k + 1] in self.ids:
                log.append((self.ids[parts[k]], self.ids[parts[k + 1]]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two pieces gives back the two pieces."""
        pair = a * len(self.pieces) + b
        at = pair % len(self.fits)
        known = self.fits[at]
        if known != pair and known != -2 - pair:
            known = self.fits[at] = pair if self._compatible(a, b) else -2 - pair
        return known == pair

    def _compatible(self, a: int, b: int) -> bool:
        if a in self.tied or b in self.tied:
            try:
                return self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
            except KeyError:
                return False
        # The two pieces are taken apart along the boundary, the latest merge first. x and y are what stands left
        # and right of the boundary until x_ends and y_ends, the ranks of the merges that use them up.
        x, y, x_ends, y_ends = a, b, float("inf"), float("inf")
        while True:
            joint = self.pair.get((x, y))
            if joint is not None and joint in self.tied:
                return self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
            # At equal rank the left merge goes first: it takes x away from the boundary, but not y.
            if joint is not None and self.rank[joint] < x_ends and self.rank[joint] <= y_ends:
                return False
            x_made = self.rank[x] if x in self.split else -1
            y_made = self.rank[y] if y in self.split else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made or x_made == y_made and y_made < 0:
                x_ends, x = x_made, self.split[x][1]
            else:
                y_ends, y = y_made, self.split[y][0]

    def encode_part(self, part: str) -> list[int]:
        """Ids of one part, in which spaces are already SPACE."""
        one = self.ids.get(part)
        if one is not None and (one in self.split or len(part) == 1):
            return [one]
        if self.known.issuperset(part):
            return self._backtrack(part)
        out: list[int] = []
        at, n = 0, len(part)
        while at < n:  # characters that are no piece stand alone and become bytes
            if part[at] not in self.known:
                out += [self.bytes.get(x, self.unk) for x in part[at].encode("utf-8", "replace")] if self.bytes else [self.unk]
                at += 1
                continue
            to = at + 1
            while to < n and part[to] in self.known:
                to += 1
            out += self._backtrack(part[at:to])
            at = to
        return out

    def matches(self, text: str) -> list[int]:
        """The longest piece that starts at each position. Ends ascend, so it comes last."""
        size, found = self.size, [-1] * len(text)
        for end, i in self.automaton.iter(text):
            found[end - size[i] + 1] = i
        return found

    def _backtrack(self, text: str) -> list[int] | array:
        size, shorter, fits, n = self.size, self.shorter, self.fits, len(text)
        many, places, longest = len(self.pieces), len(fits), self.automaton.iter_long
        failed, any_failed = None, False  # bit p: no way on from position p
        # i: the longest piece not yet tried at this position. next_at: where the automaton's next match starts.
        if n <= WINDOW:
            found, ids, run = None, [], longest(text)
            end, i = next(run)
            next_at = end + 1
        else:
            found, ids, next_at = _Matches(self, text), array("i"), -1
            i = found[0]
        at, last = 0, -1
        while True:
            while i >= 0:
                if last < 0 or (fit := fits[(pair := last * many + i) % places]) == pair or fit != -2 - pair and self.compatible(last, i):
                    to = at + size[i]
                    if not any_failed or not failed[to >> 3] >> (to & 7) & 1:
                        break
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                if to == n:
                    return ids
                at, last = to, i
                if found is not None:
                    i = found[to]
                    continue
                if to != next_at:
                    run = longest(text, to)
                end, i = next(run)
                next_at = end + 1
            else:
                if not ids:
                    raise ValueError("the vocabulary can't encode this text")
                if not any_failed:
                    failed, any_failed = bytearray(n // 8 + 1), True
                failed[at >> 3] |= 1 << (at & 7)
                i = ids.pop()
                at -= size[i]
                i, last = shorter[i], ids[-1] if ids else -1

    def segments(self, text: str) -> Iterator[str]:
        """The text in segments whose parts() are those of the whole: a segment ends before a single space between two
        other characters that are no newlines, and that space isn't in any."""
        at, n = 0, len(text)
        while n - at > SEGMENT and self.cuts_all:
            cut = text.find(" ", at + SEGMENT)
            while 0 <= cut < n - 1 and (text[cut - 1] in " \n" or text[cut + 1] in " \n"):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut >= n - 1:
                break
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def parts(self, text: str) -> list[str]:
        """The text cut where no piece can cross. A part that starts with a newline has no space before it; all
        others stand for a space and what follows."""
        if not self.cuts_all:
            return [text]
        out = text.replace("\n", " \n").split(" ")
        if "" in out:
            runs, held = [], 0
            for k, p in enumerate(out):
                if not p and k + 1 < len(out):
                    held += 1
                elif p[:1] == "\n" and held:
                    runs += [" " * (held - 1), p]
                    held = 0
                else:
                    runs.append(" " * held + p)
                    held = 0
            out = runs
        return out

    def encode_key(self, key: str) -> list[int]:
        """Ids of one of parts()."""
        if not self.cuts_all:
            return self._plain((" " if self.prefix else "") + key)
        if key[:1] == "\n":
            return [*self.encode_part("\n"), *self._plain(key[1:])]
        return self.encode_part(SPACE + key.replace(" ", SPACE))

    def _plain(self, text: str) -> list[int]:
        return self.encode_part(text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """All ids of a whole text, without control pieces."""
        return [int(i) for ids in self.encode_segments(text) for i in ids.split()]

    def encode_segments(self, text: str) -> Iterator[str]:
        """The ids of each segment of a text, as decimal numbers joined by single spaces. Nothing for an empty text."""
        text = text.replace(SPACE, " ")
        if text:
            memo = self.memo
            for segment in self.segments(text):
                yield " ".join([memo[p] for p in self.parts(segment)])

    def pretokens(self, text: str) -> Iterator[str]:
        """parts() of the whole text, segment by segment."""
        if text:
            for segment in self.segments(text.replace(SPACE, " ")):
                yield from self.parts(segment)

    def decode(self, ids: list[str], first: bool = True) -> str:
        """Text of ids given as decimal strings: pieces joined, spaces restored, byte pieces as UTF-8 with U+FFFD
        for what isn't, control pieces left out, the space that encoding puts first taken off, if these are the first.
        A later segment starts with a space of its own, so no character's bytes lie in two segments."""
        text_of = self.text_of
        try:
            out = "".join([text_of[i] for i in ids])
        except KeyError:
            parts: list[str] = []
            held = bytearray()
            for i in ids:
                k = int(i)
                if self.types[k] == 6:
                    held.append(int(self.pieces[k][3:5], 16))
                    continue
                if held:
                    parts.append(_utf8(bytes(held)))
                    held.clear()
                parts.append(text_of[i] if self.types[k] == 1 else " ⁇ " if self.types[k] == 2 else "")
            if held:
                parts.append(_utf8(bytes(held)))
            out = "".join(parts)
        return out[1:] if first and self.prefix and out[:1] == " " else out


class _Memo(dict):
    """Part -> its ids as a string. Bounded: when it is full it starts anew, but what was in it is still looked up once
    more, so frequent parts stay."""

    def __init__(self, model: PieceModel):
        self.model, self.before, self.ends = model, {}, {}

    def __missing__(self, key: str) -> str:
        if len(key) > MEMO_CHARS:
            return self.named(self.model.encode_key(key))
        ids = self.before.get(key)
        if ids is None:
            ids = self.found(key)
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        self[key] = ids
        return ids

    def named(self, ids: list[int]) -> str:
        names = self.model.names
        return " ".join([names[i] for i in ids])

    def found(self, key: str) -> str:
        """The ids of a part: those of the part without the signs it ends in and of these, or of the whole."""
        model, ends = self.model, self.ends
        stem = key.rstrip(model.signs)
        n = len(stem)
        if not 0 < n < len(key) or not stem[-1].isalnum() or key[n - 1 : n + 1] in model.joined or not model.cuts_all:
            return self.named(model.encode_key(key))
        end = key[n:]
        ids = ends.get(end)
        if ids is None:
            if len(ends) >= ENDS:
                ends.clear()
            ids = ends[end] = self.named(model.encode_part(end))
        return f"{self[stem]} {ids}"


def _utf8(raw: bytes) -> str:
    """One U+FFFD for each byte that isn't part of a character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


@lru_cache(4)
def model(path: str) -> PieceModel:
    """One model for each Python worker and file."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True, decoded: bool = True) -> DataFrame:
    """Columns id, ids (array of int), same (whether decoding gives the text back) and, if asked for, decoded: the encoding
    of every whole text and what it decodes to.

    A null text is an empty one: no ids but the end id. Texts of any length are encoded whole. Rows are independent:
    repeated rows, null or repeated ids come out as often as they went in, and an empty table gives an empty one. Other
    columns of docs, whatever their names, play no part.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, same boolean" + ", decoded string" * decoded
    form = arrow_schema(schema)

    def make():
        m = model(model_path)
        end = [m.end_id] if add_end else []

        def step(cols):
            # Ids leave as one flat array of the rows at hand: as rows they would be copied twice and wait for others.
            ids, ends, same, texts = array("i"), array("i", [0]), [], []
            for t in cols[1]:
                out, is_same, at = [], True, 0
                plain = (t or "").replace(SPACE, " ")  # which decodes to a space
                for segment in m.encode_segments(plain):
                    own = segment.split()
                    ids.extend(map(int, own))
                    back = m.decode(own, not at)
                    is_same = is_same and plain.startswith(back, at)
                    at += len(back)
                    if decoded:
                        out.append(back)
                ids.extend(end)
                ends.append(len(ids))
                same.append(is_same and at == len(plain) and plain == (t or ""))
                texts.append("".join(out))
            lists = pa.ListArray.from_arrays(_flat(ends), _flat(ids), type=form.field(1).type)
            rest = [pa.array(texts, form.field(3).type)] if decoded else []
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], form.field(0).type), lists, pa.array(same, pa.bool_()), *rest], schema=form)

        return step

    return map_rows(docs.select(id_col, text_col), make, schema)


def _flat(numbers: array) -> pa.Array:
    """32-bit numbers as they lie, uncopied."""
    return pa.Array.from_buffers(pa.int32(), len(numbers), [None, pa.py_buffer(numbers)])


def digest_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_end: bool = True) -> DataFrame:
    """As encode_documents(), but only digests leave the worker: n_tokens, ids_sha256 (of the decimal ids joined
    by one space), decoded_sha256 (of the decoded text in UTF-8), each made segment by segment."""

    def make():
        m = model(model_path)
        end = [str(m.end_id)] if add_end else []

        def step(cols):
            for i, t in zip(*cols):
                n, ids, text = 0, hashlib.sha256(), hashlib.sha256()
                for segment in m.encode_segments(t or ""):
                    own = segment.split()
                    ids.update(f" {segment}".encode() if n else segment.encode())
                    text.update(m.decode(own, not n).encode())
                    n += len(own)
                for x in end:
                    ids.update(f" {x}".encode() if n else x.encode())
                    n += 1
                yield i, n, ids.hexdigest(), text.hexdigest()

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_model())
