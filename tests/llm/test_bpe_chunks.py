import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from stintlab.llm import bpe_chunks
from stintlab.llm import textbytes as tb
from stintlab.llm.tokens import vocabulary

from .helpers import frame, rows, sample_texts

PATH, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def tricky(seed=9):
    r = random.Random(seed)
    pieces = [" ", "  ", "\n", "\t", "a", "word", "'s", "'", "é", "ß", "日", "😀", "1", "23", "!", "...", " ", "　", "<|endoftext|>", "<|", "|>", "the", " The"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 400))) for _ in range(60)]


@pytest.mark.parametrize("bits", [10, 3, 0])
@pytest.mark.parametrize("ranks", [RANKS, None])
def test_ids_equal_the_tokenizer(tokenizer, monkeypatch, bits, ranks):
    monkeypatch.setattr(bpe_chunks, "CUT_BITS", bits)  # from few cuts to one at every byte
    encoder = bpe_chunks.ChunkEncoder(PATH, ranks)
    texts = [t or "" for t in sample_texts()] + tricky()
    for group in tb.groups(pa.array(texts, pa.string()), 20_000):
        ids, bounds = encoder.encode(group)
        for k, row in enumerate(group.rows):
            want = tokenizer.encode(texts[row], add_special_tokens=False).ids
            got = ids[bounds[k]:bounds[k + 1]]
            assert got.tolist() == want, texts[row][:60]
            assert encoder.decode(got) == tokenizer.decode(want, skip_special_tokens=False)


def test_rank_file_agrees_below_u0240(tokenizer):
    encoder = bpe_chunks.ChunkEncoder(PATH, RANKS)
    for c in map(chr, range(1, 0x240)):
        for text in (c, f"a{c}b", f" {c} ", f"1{c}'s{c}{c}", f"\n{c}x {c}."):
            assert encoder._ids(text.encode(), False).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_copies_are_encoded_once():
    encoder = bpe_chunks.ChunkEncoder(PATH, RANKS)
    text = sample_texts()[-13 + 1 - 1] or ""
    long = " ".join(t for t in sample_texts() if t)
    (group,) = tb.groups(pa.array([long], pa.string()), 1 << 30)
    encoder.encode(group)
    known = len(encoder.index)
    (group,) = tb.groups(pa.array([long, long, text + " " + long], pa.string()), 1 << 30)
    encoder.encode(group)
    assert known <= len(encoder.index) <= known + 4


def test_frame_results(spark, tokenizer):
    data = rows() + [rows()[2], (None, "null id", None, None, None)]
    want = sorted((str(i), (ids := tokenizer.encode(t or "", add_special_tokens=False).ids), tokenizer.decode(ids, skip_special_tokens=False)) for i, t, *_ in data)
    out = bpe_chunks.encode_texts(frame(spark, data), PATH, RANKS)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in out.collect()) == want
    out = bpe_chunks.encode_texts(frame(spark, data), PATH, RANKS, digests=True)
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == sorted(
        (i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, x, d in want)
    assert bpe_chunks.encode_texts(frame(spark, []), PATH, RANKS).count() == 0
