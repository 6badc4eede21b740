import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stintlab.llm import cross_tokens
from stintlab.llm.bpe_chunks import _piece_table
from stintlab.llm.tokens import load_tokenizer, vocabulary

from .helpers import frame, rows

A, B, RANKS = (vocabulary(f"{name}") for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


PIECES = _piece_table(A)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece

    a = load_tokenizer(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def whole(text, a, b):
    """Ids and byte lengths of a whole text in both vocabularies by the libraries; None where bytes differ."""
    pieces, bounds = PIECES
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xs = [pieces[bounds[i]:bounds[i + 1]].tobytes() for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in y]
    full = (" " + text).encode()
    return (x, [len(p) for p in xs], y, [len(p) for p in ys]) if b"".join(xs) == full == b"".join(ys) else None


def brute(data, a, b):
    found = {t: whole(t, a, b) if t else None for t in {r[1] for r in data}}
    told, counts = {}, Counter()
    for text, coded in found.items():
        if coded is None:
            continue
        x, xs, y, ys = coded
        owner_x, owner_y = np.repeat(np.arange(len(x)), xs), np.repeat(np.arange(len(y)), ys)
        links = sorted(set(zip(owner_x.tolist(), owner_y.tolist())))
        ends = sorted(set(np.cumsum(xs).tolist()) & set(np.cumsum(ys).tolist()))
        groups, lo = [], 0
        for hi in ends:
            mine = [",".join(str(ids[k]) for k in sorted(set(owner[lo:hi].tolist()))) for ids, owner in ((x, owner_x), (y, owner_y))]
            groups.append("|".join(mine))
            lo = hi
        told[text] = (len(x), len(y), groups, [(x[i], y[j]) for i, j in links])
        copies = sum(r[1] == text for r in data)
        for pair in told[text][3]:
            counts[pair] += copies
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for doc_id, text, *_ in data:
        if text in told:
            n_a, n_b, groups, links = told[text]
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
                        sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        else:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
    return sorted(out, key=str)


ODD = ["", None, " ", "  ", "   a", "a ", "a  ", "a   b", "a\n\n b", "a \tb", "x\u2581y", "\u2581", "<|endoftext|> a <s> <0x41></s>", "\x00\x01",
       "\u00a0 a\u00a0 b", "\u4f60\u597d \u4e16\u754c", "na\u00efve caf\u00e9 d'\u00e9t\u00e9", "\U0001f600 ok \U0001f1eb\U0001f1f7", "a\u2003 b \u2003c",
       "\ufb01 \u0130 \u01c5", "e\u0301 o\u0308", "1234567 89", "it's we'll 's", "a" * 3000, "\n", "\r\n a\r\n", "a~ ~ b! !!  !!", "\u200b x"]


def corpus():
    data = rows() + [(1000 + k, t, "en", "s", 0) for k, t in enumerate(ODD)]
    return data + [data[0], data[0], (None, data[1][1], "x", "y", 1), (2000, "a  b", "x", "y", 1)]


def test_equals_brute_force(spark, libraries):
    data = corpus()
    out = cross_tokens.align_corpus(frame(spark, data), A, B, RANKS)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(data, *libraries)


@pytest.mark.parametrize("size", [1, 7])
def test_chunks_of_few_texts(libraries, size):
    """Chunks of a few bytes give the same measures when the corpus-wide counts are put together by hand."""
    data = corpus()
    texts = list(dict.fromkeys(t for _, t, *_ in data if t))
    copies = [sum(r[1] == t for r in data) for t in texts]
    aligner = cross_tokens.Aligner.of(A, RANKS, B)
    blocks, lo = [], 0
    while lo < len(texts):
        hi = min(lo + size, len(texts))
        blocks.append(pa.Table.from_batches([cross_tokens._chunk(aligner, lo, [t.encode() for t in texts[lo:hi]], [t.encode() for t in texts[lo:hi]], copies[lo:hi])]))
        lo = hi
    counts = Counter()
    for block in blocks:
        for pair, weight in zip(block["pairs"][0].as_py(), block["weights"][0].as_py()):
            counts[pair] += weight
    top = Counter()
    for pair, n in counts.items():
        top[pair % cross_tokens.B_IDS] = max(top[pair % cross_tokens.B_IDS], n)
    found = {}
    for block in blocks:
        keys = block["pairs"][0].as_py()
        sums = pa.table([keys, [counts[k] for k in keys], [int(counts[k] == top[k % cross_tokens.B_IDS]) for k in keys]], ["pair", "links", "best"])
        for r in cross_tokens._measured(block, sums).to_pylist():
            text = r.pop("digest").decode()
            found[text] = tuple(r.values())
    assert sorted(((i, *found.get(t, (0, 0, 0, 0, 0, 0, ""))) for i, t, *_ in data), key=str) == brute(data, *libraries)


def test_units_equal_whole_texts(libraries):
    """Encoding by units equals the libraries on whole texts of odd characters and runs of white space."""
    r = np.random.default_rng(3)
    letters = list(" " * 12 + "\n\t" + "abcdeABC129.,!'-~$") + ["\u00e9", "\u00a0", "\u2003", "\u4f60", "\u0301", "\u023f", "\u0240", "\U0001f600", "\x85", " the", " '", "'s", "  "]
    aligner = cross_tokens.Aligner.of(A, RANKS, B)
    for _ in range(1500):
        text = "".join(r.choice(letters, r.integers(1, 30)))
        x, _, y, _ = whole(text, *libraries)
        at, _ = aligner.units([text.encode()])
        told = "".join(aligner.told[u] for u in at.tolist())[:-1]
        groups = [g.split("|") for g in told.split(";")]
        assert [int(i) for g in groups for i in g[0].split(",")] == x
        assert [int(i) for g in groups for i in g[1].split(",")] == y


def test_no_b_piece_holds_a_space_after_another_character(libraries):
    """What lets B be encoded by units: spaces stand only at the start of pieces (or make up all of one)."""
    b = libraries[1]
    for i in range(len(b)):
        piece = b.id_to_piece(i)
        assert "\u2581" not in piece.lstrip("\u2581")


def test_empty_table(spark):
    assert cross_tokens.align_corpus(frame(spark, []), A, B, RANKS).count() == 0
