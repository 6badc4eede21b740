import zlib

import numpy as np
import pytest

from stintlab.llm import packing
from stintlab.llm.tokens import WordEncoder, vocabulary

from .helpers import frame, rows, sample_texts

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    texts = [t or "" for t in sample_texts()] + ["it's I'LL we've", "é Å", "Σίσυφος ΟΔΟΣ", "İstanbul", "1234 5,6"]
    ids, bounds = WordEncoder(PATH).encode([t.encode() for t in texts])
    for k, text in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


def test_plain_words_equal_the_tokenizer(tokenizer):
    """Every printable ASCII and Latin-1 letter in several surroundings, and the file's other characters."""
    encoder = WordEncoder(PATH)
    assert encoder.known_steps
    words = [f.format(c) for c in map(chr, [*range(1, 0x250), 0x301, 0x3A3, 0x1E9E, 0x2028, 0x3000, 0xFB01, 0x1F600])
             for f in ("{0}", "a{0}b", "{0}s", "'{0}", "1{0}2", "A{0}E{0}", ".{0}!")]
    words += ["it's", "I'LL", "don't", "x'reY", "'s", "''ve", "<|endoftext|>x", "A<|startoftext|>", "<|", "ÀÉÎÕÜÞß", "×÷", "ªº", "µ"]
    for text in words:
        ids, _ = encoder.encode([text.encode()])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check(out, ids, tokens, segments, loss, padded=0):
    pieces, sequences = {}, {}
    for r in out.collect():
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (i, n), found in pieces.items():
        copies = [x for x in ids if x[0] == i and len(x[1]) == n]
        assert sum(r["length"] for r in found) == n * len(copies)
        for r in found:
            part = copies[0][1][r["start"]:r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    waste = 0
    for found in sequences.values():
        at = 0
        for k, r in enumerate(sorted(found, key=lambda r: r["offset"])):
            assert (r["offset"], r["segment"]) == (at, k)
            at += r["length"]
        assert 0 < at <= tokens and len(found) <= segments and sum(r["loss_tokens"] for r in found) <= loss
        waste += 0 if at & (at - 1) == 0 else tokens - at
    assert waste <= padded
    return sequences


def test_every_id_once_without_padding(spark, tokenizer):
    data = rows() + [(None, "null id", None, None, None)]
    ids = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in data]
    out = packing.pack(frame(spark, data), PATH).cache()
    check(out, ids, 4096, 1024, 4096)
    assert out.agg({"length": "sum"}).first()[0] == sum(len(x) for _, x in ids)
    check(packing.pack(frame(spark, data), PATH, tokens=64, segments=4), ids, 64, 4, 64, padded=20_000)


def test_loss_limit_of_instruction_data(spark, tokenizer):
    data = [(k, [("question " * (k % 9 + 1), False), ("answer " * (k % 13 + 1), True)]) for k in range(120)] + [(999, None), (998, [])]
    df = spark.createDataFrame(data, "doc_id long, parts array<struct<text string, loss boolean>>")
    ids = [(k, [i for text, _ in parts or [] for i in tokenizer.encode(text, add_special_tokens=False).ids] + [2]) for k, parts in data]
    whole = check(packing.pack(df, PATH, parts_col="parts", tokens=128, segments=16, loss_tokens=60, cut=False), ids, 128, 16, 60, padded=10**6)
    tokens = sum(len(x) for _, x in ids)
    bears = sum(len(tokenizer.encode(p[1][0], add_special_tokens=False).ids) + 1 for _, p in data if p)
    least = max(tokens / 128, bears / 60, 122 / 16)
    assert len(whole) <= 1.25 * least + 4  # near the lower bound of any packing, over 2 partitions
    assert packing.pack(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("length", [3, 7])
def test_streams_of_short_examples_need_no_padding(length):
    packer, sequences = packing.Packer(4096, 1024, 4096), []
    for k in range(5000):
        sequences += packer.add(packing.Piece(k, 0, np.full(length, k, np.int32), np.arange(length + 1), length))
    sequences += packer.finish()
    found = sorted((int(p.ids[0]), p.start, len(p.ids)) for s in sequences for p in s)
    assert sum(n for *_, n in found) == 5000 * length and len({(k, s) for k, s, _ in found}) == len(found)
    sizes = [sum(len(p.ids) for p in s) for s in sequences]
    assert all(n & (n - 1) == 0 and n <= 4096 for n in sizes) and max(map(len, sequences)) <= 1024


def test_instruction_pairs_keep_all_limits(spark, tokenizer):
    from stintlab.llm import queries

    sf = "/root/testdata/sf0.001"
    turns = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    size = lambda r: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    want = {}
    for (conv, turn), r in turns.items():
        if r["role"] == "assistant":
            before = turns.get((conv, turn - 1))
            want[conv * 65536 + turn] = ((size(before) if before and before["role"] == "user" else 0) + size(r) + 1, size(r) + 1)
    found, sequences = {}, {}
    for r in queries.QUERIES["pack_instruction_pairs"](spark, sf).collect():
        n, loss = found.get(r["example"], (0, 0))
        found[r["example"]] = (n + r["length"], loss + r["loss_tokens"])
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert found == want
    assert all(sum(r["length"] for r in s) <= 2048 and len(s) <= 8 and sum(r["loss_tokens"] for r in s) <= 1024 for s in sequences.values())


def test_dot_product_prefers_the_scarce_limit():
    packer = packing.Packer(100, 10, 50, cut=False, waiting=8)
    piece = lambda name, n, loss: packing.Piece(name, 0, np.zeros(n, np.int32), np.linspace(0, loss, n + 1).astype(int), n)
    for name, n, loss in (("long", 60, 0), ("lossy", 50, 50), ("rest", 40, 0)):
        packer._wait(piece(name, n, loss))
    sequences = [{p.example for p in s} for s in packer.finish()]
    assert sequences == [{"lossy", "rest"}, {"long"}] or sequences == [{"lossy"}, {"long", "rest"}]
    with pytest.raises(ValueError):
        packing.Packer(0, 1, 1)
