"""Encoding by the agenda against the sentencepiece library."""
import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from tocsin.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the ", " ", "  ", "\n", "\t", "é", "é", "日本", "\U0001f600", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "▁", "▁▁", "word",
         "ing", "'s", "....", "12", "　", "aaaaaaa", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return piece_bpe.Model(f.read())


def texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def ids_of(body):
    return list(struct.unpack(f"<{len(body) // 4}I", body))


def test_agenda_like_the_library(library, model):
    for t in texts(3000, 1) + ["x" * 5_000, " " * 5_000, "ab" * 3_000, "日" * 100]:
        assert ids_of(model.encode(t)) == library.encode(t), t
        whole = piece_bpe.BLANK + t.replace(" ", piece_bpe.BLANK) if t else ""
        assert "".join(model.merged(whole)) == whole


def test_list_and_heap_agree(model, monkeypatch):
    own = [t.replace(" ", piece_bpe.BLANK)[:32] for t in texts(2000, 6)] + ["▁" * 30, "aaaaaaaaaaa", "▁internationalisation"]
    by_list = [model.merged(t) for t in own]
    monkeypatch.setattr(piece_bpe, "SHORT", 0)
    assert [model.merged(t) for t in own] == by_list


def test_words_or_the_whole_text(model, monkeypatch):
    own = texts(300, 2) + ["5 m².x", "m².²._a", "²_²"]
    by_words = [model.encode(t) for t in own]
    monkeypatch.setattr(model, "cuts", False)
    assert [model.encode(t) for t in own] == by_words


def test_chunks_join_to_the_whole(model):
    for t in texts(400, 3):
        starts = piece_bpe.cuts(t, 5)
        chunks = [t[a:z] for a, z in zip(starts, [*starts[1:], len(t)])]
        assert "".join(chunks) == t and b"".join(model.encode(c, k == 0) for k, c in enumerate(chunks)) == model.encode(t)


@pytest.mark.parametrize("chunk", [1 << 18, 11])
def test_encode_and_decode(docs, library, chunk):
    own = texts(60, 4) + [None, "", " " * 300_000, "x" * 20_000, "some words " * 30_000, "same text twice", "same text twice"]
    ids = [*range(len(own) - 3), None, 777, 777]
    got = piece_bpe.encode(docs(own, ids=ids), PATH, chunk)
    got = piece_bpe.digests(got).collect()
    want = []
    for k, t in zip(ids, own):
        tokens = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((k, len(tokens), hashlib.sha256(struct.pack(f"<{len(tokens)}I", *tokens)).hexdigest(),
                     hashlib.sha256(library.decode(tokens).encode()).hexdigest(), True))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_wrong_id_is_seen(library):
    with open(PATH, "rb") as f:
        own = piece_bpe.Library(f.read())
    bodies = [own.model.encode("fine"), own.model.encode("other")]
    assert own.finished(["fine", "fine"], bodies)[2] == [True, False]


def test_models_it_can_not_serve(model):
    with open(PATH, "rb") as f:
        content = f.read()
    with pytest.raises(ValueError):
        piece_bpe.Model(content + bytes([26, 2, 32, 1]))  # a normaliser that drops blanks
    with pytest.raises(ValueError):
        piece_bpe.Model(content + bytes([10, 5, 10, 1, 120, 24, 4]))  # a piece of the user's own


def test_empty(table):
    assert piece_bpe.encode(table([], "doc_id long, text string"), PATH).collect() == []
