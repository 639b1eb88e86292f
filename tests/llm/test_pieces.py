import hashlib
import random
import tracemalloc
from array import array

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from tessera.llm import counts, pieces
from tessera.llm.counts import count_tokens, op3_token_counts
from tessera.llm.pieces import default_model, digest_documents, encode_documents, model

EDGE = ["", " ", "  ", "\n", "a\nb", "a \n b", " lead", "trail ", "▁x ▁▁y", "\x00\t<s></s><0x41>", "日本語 🙂 ñ", "x" * 5000, " " * 300, "ab" * 3000 + "\n" * 50, None]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_encode_equals_the_library_on_random_text(sp):
    m, rng = model(default_model()), random.Random(7)
    letters = "  \n\tabcdefgthe▁ing éüñ日本🙂\x00()[]{}=+-*/<>.,0123ABC "
    pieces = [m.pieces[i] for i in m.ids.values()]
    for k in range(4000):
        n = rng.randint(0, 40)
        s = "".join(rng.choice(letters) for _ in range(n)) if k % 2 else "".join(rng.choice(pieces) for _ in range(n // 3)).replace("▁", " ")
        assert m.encode(s) == sp.encode(s), s
        ids = [i for part in m.encode_segments(s) for i in part.split()]
        assert list(map(int, ids)) == sp.encode(s)
        assert m.decode(ids) == sp.decode(sp.encode(s))


def test_segments_and_windows_change_nothing(sp, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENT", 7)
    monkeypatch.setattr(pieces, "WINDOW", 4)
    monkeypatch.setattr(pieces, "WINDOWS", 2)
    m, rng = pieces.PieceModel(default_model()), random.Random(11)
    for k in range(1500):
        s = "".join(rng.choice("  \nabthe▁ingéü🙂=") for _ in range(rng.randint(0, 90)))
        s = s.replace(" ", "") if k % 3 == 0 else s
        found = [x.split() for x in m.encode_segments(s)]
        assert [int(i) for x in found for i in x] == sp.encode(s), s
        assert "".join(m.decode(x, not i) for i, x in enumerate(found)) == sp.decode(sp.encode(s))
        assert sum(len(m.encode_key(p)) for p in m.pretokens(s)) == len(sp.encode(s))


def test_very_long_texts(spark, sp):
    rng = random.Random(13)
    texts = ["".join(rng.choice("abcdeinorst") for _ in range(300_000)), " ".join(rng.choice(["the", "of", "x1", "", "é\n"]) for _ in range(400_000)), "=" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in digest_documents(docs, default_model()).collect()}
    counted = {r.doc_id: r.n_tokens for r in count_tokens(docs, default_model()).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t, add_eos=True)
        assert got[i].n_tokens == len(ids) == counted[i] + 1
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_a_frequent_long_pretoken_is_broadcast(spark, sp, monkeypatch):
    monkeypatch.setattr(counts, "HOT", 3)
    line = "-" * 90
    docs = spark.createDataFrame([(k, f"a {line} b{k} {line}") for k in range(40)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, default_model()).collect()} == {k: len(sp.encode(f"a {line} b{k} {line}")) for k in range(40)}


def test_decode_of_broken_byte_pieces(sp):
    m = model(default_model())
    for raw in (b"\xe6\x97", b"\xff\xfea", b"\xe6\x97\xa5\xe6", b"\xf0\x9f\x99"):
        ids = [m.bytes[b] for b in raw]
        assert m.decode(list(map(str, ids))) == sp.decode(ids)


def test_compatible_is_re_merging(sp):
    m, rng = model(default_model()), random.Random(3)
    ids = list(m.split)
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert m._compatible(a, b) == (m.merge(m.pieces[a] + m.pieces[b]) == [a, b])


def test_remembered_pairs_are_small_and_right(sp, monkeypatch):
    monkeypatch.setattr(pieces, "PAIRS", 7)  # nearly every pair takes another's place
    m, rng = pieces.PieceModel(default_model()), random.Random(5)
    ids = list(m.split)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(500)]
    assert [m.compatible(a, b) for a, b in pairs * 2] == [m._compatible(a, b) for a, b in pairs] * 2
    assert m.encode("remembered pairs 日本 take places" * 40) == sp.encode("remembered pairs 日本 take places" * 40)
    monkeypatch.undo()
    tracemalloc.start()
    try:
        m.fits = type(m.fits)("q", [-1]) * pieces.PAIRS if isinstance(m.fits, array) else {}
        for k in range(150_000):
            m.compatible(ids[k % 500], ids[k // 500])
        assert tracemalloc.get_traced_memory()[0] < 10_000_000
    finally:
        tracemalloc.stop()


def test_words_are_walked_once(sp, monkeypatch):
    """Signs after a word are no new word, and frequent words stay when the memo starts anew."""
    monkeypatch.setattr(pieces, "MEMO", 50)
    m, walked = pieces.PieceModel(default_model()), []
    part = m.encode_part
    m.encode_part = lambda text: walked.append(text) or part(text)
    texts = [f"qoulaouea, x{k}w qoulaouea. \nqoulaouea; qoulaouea&&& qoulaouea" for k in range(200)]
    assert [m.encode(t) for t in texts] == [sp.encode(t) for t in texts]
    assert walked.count("▁qoulaouea") == 1 and not any(w.startswith("▁qoulaouea") for w in set(walked) - {"▁qoulaouea"})
    assert len(m.memo) + len(m.memo.before) <= 100


def test_longest_and_shorter_are_all_matches(sp):
    m, rng = model(default_model()), random.Random(17)
    known = {p: i for p, i in m.ids.items() if len(p) == 1 or i in m.split}
    for _ in range(300):
        s = "".join(rng.choice(list(known)) for _ in range(6))
        found = m.matches(s)
        for at in range(len(s)):
            assert [i for end, i in [next(m.automaton.iter_long(s, at))]] == [found[at]]
            own, i = [], found[at]
            while i >= 0:
                own.append(i)
                i = m.shorter[i]
            assert own == [known[s[at:to]] for to in range(len(s), at, -1) if s[at:to] in known]


def test_signs_after_words_and_parts_about_a_window(sp, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 30)
    monkeypatch.setattr(pieces, "ENDS", 3)
    m, rng = pieces.PieceModel(default_model()), random.Random(19)
    signs = [*m.signs, "日.", "▁", " ", "\n", "\t", "e.g.", "()", "..."]
    for k in range(3000):
        s = "".join(rng.choice(["the", "ou", "x9", "É", "日", " "]) + "".join(rng.choice(signs) for _ in range(rng.randint(0, 3))) for _ in range(8))
        assert m.encode(s) == sp.encode(s), s
    for n in (pieces.WINDOW - 2, pieces.WINDOW - 1, pieces.WINDOW, pieces.WINDOW + 1, 5 * pieces.WINDOW):
        s = "".join(rng.choice("abdeinorstu=") for _ in range(n))
        assert m.encode(s) == sp.encode(s)


def test_ids_leave_as_they_lie(spark, monkeypatch):
    """Whole Arrow batches of a slice's rows, not rows that wait for others."""
    made = []
    monkeypatch.setattr(pieces, "map_rows", lambda df, make, schema: made.append(make))
    encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), default_model(), decoded=False)
    (out,) = made[0]()([[1, None, 1], ["a b", None, "a b"]])
    a, b = out.column(1)[0].as_py(), out.column(1)[1].as_py()
    assert out.column(0).to_pylist() == [1, None, 1] and out.column(1).to_pylist() == [a, b, a] and len(b) == 1 and out.column(2).to_pylist() == [True] * 3


def test_documents(spark, sp):
    rows = [(i, t, "x") for i, t in enumerate(EDGE)] + [(0, "again", "x"), (0, "again", "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    back = {t: sp.decode(sp.encode(t or "", add_eos=True)) for _, t, _ in rows}
    got = sorted(map(tuple, encode_documents(docs, default_model()).collect()), key=str)
    want = sorted(((i, sp.encode(t or "", add_eos=True), back[t] == (t or ""), back[t]) for i, t, _ in rows), key=str)
    assert got == want
    assert encode_documents(docs, default_model(), decoded=False).columns == ["doc_id", "ids", "same"]
    digests = sorted(map(tuple, digest_documents(docs, default_model()).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digests == sorted(((i, len(ids := sp.encode(t or "", add_eos=True)), sha(" ".join(map(str, ids))), sha(back[t])) for i, t, _ in rows), key=str)
    counted = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, default_model()).collect()), key=str)
    assert counted == sorted(((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in rows), key=str)
    assert digest_documents(docs.limit(0), default_model()).count() == 0
    assert count_tokens(docs.limit(0), default_model()).count() == 0


def test_op3_equals_the_library(spark, sf, sp):
    got = {r.doc_id: r.n_tokens for r in op3_token_counts(spark, sf).collect()}
    want = {r.doc_id: len(sp.encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want
