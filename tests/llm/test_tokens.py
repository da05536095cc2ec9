"""Byte-level BPE and token counts against the libraries."""
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tocsin.llm import byte_bpe, token_counts
from tocsin.llm.byte_bpe import boundaries, load_ranks, stitched

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN
PARTS = ["a", "'", "l", "s", "re", " ", "\n", "1", "!", "é", "É", "  ", " 'll", "\u3000", "aaaaaaa", "\x1c", "Σ", "ΑΣ", "e\u0301",
         "bbbbbbbbbbbbbbbbbbbbbbbb", "          ", "<|endoftext|>", "_", "the ", "\U0001f600", "\ua7cb"]


def texts(n, seed, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_stitching_is_exact():
    split, rng = regex.compile(PATTERN), random.Random(1)
    for t in texts(1500, 2):
        size = rng.randint(6, 40)
        overlap = rng.randint(4, size)
        chunks = [t[k:k + size + overlap] for k in range(0, max(1, len(t)), size)]
        ends = [np.array(boundaries(split, c), dtype="<i4") for c in chunks]
        assert stitched(split, chunks, ends, size) == (t, boundaries(split, t))


@pytest.mark.parametrize("chunk,overlap", [(16_384, 512), (65_536, 1_024), (12, 5)])
def test_encode_and_decode(docs, chunk, overlap):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    own = texts(60, 3) + [None, "", " " * 70_000, "x" * 70_000, "word " * 8_000, "same text twice " * 3, "same text twice " * 3]
    ids = [*range(len(own) - 2), 777, 777]  # a repeated row
    df = docs(own, ids=ids)
    if chunk == 12:  # encoding and decoding apart
        got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN, chunk, overlap), RANKS))
    else:
        got = byte_bpe.digests(byte_bpe.encode(df, RANKS, PATTERN, chunk, overlap, decoded=True))
    want = []
    for k, t in zip(ids, own):
        tokens = library.encode_ordinary(t or "")
        want.append((k, len(tokens), hashlib.sha256(struct.pack(f"<{len(tokens)}I", *tokens)).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("chunk", [32_768, 9])
def test_token_counts(docs, chunk):
    library = Tokenizer.from_file(MODEL)
    own = texts(150, 4) + [None, "", " " * 40_000, "x" * 40_000, "it's we'll 12 " * 4_000, "<|endoftext|>" * 9, "again", "again"]
    ids = [*range(len(own) - 3), None, 777, 777]
    got = token_counts.token_counts(docs(own, ids=ids), MODEL, chunk).collect()
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in zip(ids, own)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_splitter_like_the_pattern():
    machine = token_counts.Transducer(token_counts.load_model(MODEL))
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    rng = random.Random(8)
    for _ in range(20_000):
        run = "".join(rng.choice("'stmdrvlex1!é_") for _ in range(rng.randint(0, 9)))
        assert machine.pieces(run) == pattern.findall(run), run


def test_state_maps_compose_in_any_cut():
    machine = token_counts.Transducer(token_counts.load_model(MODEL))
    rng = random.Random(9)
    for t in texts(400, 10):
        size = rng.randint(1, 20)
        chunks = [t[i:i + size] for i in range(0, len(t), size)] or [""]
        assert machine.total(machine.scan([machine.chunk_map(c) for c in chunks])) == machine.count(t)


def test_empty(table):
    df = table([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(df, RANKS, PATTERN), RANKS).collect() == []
    assert token_counts.token_counts(df, MODEL).collect() == []
