import random

import pytest
import sentencepiece

from engramix.llm import queries
from engramix.llm import sentencepiece_scan as sp

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "  a  b ", "a", "▁x▁ ▁", "Hello  world\n été 😀x ", "tab\tnew\nline\r\n", "a" * 300, "ab" * 200, "日本語の文章" * 40,
    "<s> </s> <0x0A> <unk>", "nul\x00byte", "x" * 50 + " " * 70 + "y", "ﬁ ① ½ é", "don't-stop_now/http://example.com?q=1&b=2",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH)


def scan(v, text, size):
    parts = cut = sp.cut(v, text, size)
    if not cut:
        return []
    chunks = [sp.Chunk(v, *p) for p in parts]
    states = sp.combine([c.matrix() for c in chunks])
    out = b"".join(c.backtrace(a, b) for c, a, b in zip(chunks, states, states[1:]))
    return [int.from_bytes(out[i : i + 4], "little") for i in range(0, len(out), 4)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 40, 1000])
def test_scan_equals_the_library(library, size):
    v = sp.vocabulary(sp.MODEL_PATH)
    rng = random.Random(size)
    texts = TEXTS + ["".join(rng.choice("abcdehilnorst  éß\n.,😀<>") for _ in range(rng.randrange(60))) for _ in range(120)]
    for text in texts:
        assert scan(v, text, size) == library.encode(text), text


def test_associative(library):
    """Products of neighbouring matrices give the same states."""
    v = sp.vocabulary(sp.MODEL_PATH)
    ms = [sp.Chunk(v, *p).matrix() for p in sp.cut(v, "internationalisation of thingstion" * 3, 5)]

    def times(a, b):
        return [sum(1 << j for j in range(64) if any(row >> k & 1 and b[k] >> j & 1 for k in range(len(b)))) for row in a]

    states = sp.combine(ms)
    paired = [times(a, b) for a, b in zip(ms[::2], ms[1::2])] + ([ms[-1]] if len(ms) % 2 else [])
    assert sp.combine(paired) == states[::2] + ([states[-1]] if len(ms) % 2 else [])


@pytest.mark.parametrize("chunk, fan", [(11, 2), (11, 3), (300, 64), (sp.CHUNK, 64)])
def test_frames(spark, library, monkeypatch, chunk, fan):
    monkeypatch.setattr(sp, "FAN", fan)
    texts = [None, *TEXTS, *[r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]] * 2
    if chunk == 11:
        texts = texts[:40]
    docs = spark.createDataFrame([(i % 7, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, rid int, part string")
    rows = sp.encode(docs, chunk=chunk)
    assert rows.columns == [*docs.columns, "piece_ids"]
    got = {r.rid: r.piece_ids for r in rows.collect()}
    assert got == {i: None if t is None else library.encode(t) for i, t in enumerate(texts)}
    decoded = {r.rid: r.decoded for r in sp.decode(rows).collect()}
    assert decoded == {i: None if t is None else library.decode(library.encode(t)) for i, t in enumerate(texts)}
    assert sp.encode(docs.limit(0)).collect() == []
    both = sp.encode(docs, chunk=chunk, decoded_col="again")
    assert {r.rid: (r.piece_ids, r.again) for r in both.collect()} == {i: (got[i], decoded[i]) for i in got}


def test_tree_gives_the_same_states():
    v = sp.vocabulary(sp.MODEL_PATH)
    ms = [sp.Chunk(v, *p).matrix() for p in sp.cut(v, "internationalisation of thingstion " * 4, 5)]
    for fan in (2, 3, 7):
        groups = [ms[i : i + fan] for i in range(0, len(ms), fan)]
        tops = [sp.product(g) for g in groups]
        sides = [x for g, (f, b) in zip(groups, sp.hand_down(tops, 1, 1)) for x in sp.hand_down(g, f, b)]
        assert sides == sp.hand_down(ms, 1, 1)
        assert [sp.the_only(f & sp.backward(b, m)) for m, (f, b) in zip(ms, sides)] == sp.combine(ms)[:-1]


def test_clashing_names(spark, library):
    docs = spark.createDataFrame([(1, "some words " * 9, "x", "y", 2)], "doc_id long, text string, piece_ids string, __rid string, DECODED int")
    for chunk in (20, sp.CHUNK):
        got = sp.encode(docs, chunk=chunk, decoded_col="decoded")
        assert got.columns == [*docs.columns, "_piece_ids", "_decoded"]
        assert got.first()._piece_ids == library.encode("some words " * 9)


def test_decode_broken_bytes(library):
    v = sp.vocabulary(sp.MODEL_PATH)
    for text in ["é", "😀 a", " lead", "  two"]:
        assert v.decode(library.encode(text)) == library.decode(library.encode(text))


def test_query(spark, library):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_sentencepiece"](spark, SMALL).collect()
    assert {r.doc_id: r.n_pieces for r in rows} == {d: len(library.encode(t)) for d, t in text.items()}
    assert all(r.round_trip for r in rows)
