"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over ``ROLL`` bytes cuts every text where the hash ends in ``CUT_BITS`` zero bits, so equal
passages are cut alike in all texts. A chunk's *core* lies between its first and last point of agreement: a
space between two printable ASCII characters other than spaces. The pre-splitting pattern of byte-level
BPE always starts a piece at such a space, whatever stands around it, and no special token holds a space;
so ids left and right of it do not depend on each other. Cores are encoded once per worker and reused by all
its texts. What lies between the agreement points on both sides of a cut is the join; it is re-encoded
as one piece, and grows over as many cuts as it takes to reach agreement on both sides. The result equals
encoding the whole text.

Cores with only code points below U+0240 are encoded with the rank file of the same vocabulary, others and
those with a special token with the tokenizer file itself (``tests/llm`` compares both over all these
code points). The memory of a worker is bounded by starting afresh after ``REMEMBERED_BYTES``.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows come back as
often as they came; null ids of rows pass through; an empty table gives an empty result; extra columns are
ignored. Very long texts are encoded whole (a task's memory grows with its longest text).
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .frames import pick, prepare
from .tokens import Remembered, byte_letters, load_tokenizer

ROLL = 16
CUT_BITS = 10
#: bytes of distinct cores and joins kept by a worker
REMEMBERED_BYTES = 48 << 20
#: bytes of UTF-8 text with code points below U+0240 are at most this
COMMON_BYTE = 0xC8

_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True
_POWERS = tb.WordPowers(0xD1342543DE82EF95)
_encoders: dict[tuple, "ChunkEncoder"] = {}


class ChunkEncoder(Remembered):
    def __init__(self, path: str, ranks_path: str | None = None):
        super().__init__()
        self.tokenizer, self.ranks, self.bytes_kept = load_tokenizer(path), None, 0
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(b" " in s for s in self.special):
            raise ValueError("a special token holds a space")
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces, self.piece_bounds = _piece_table(path)

    @classmethod
    def of(cls, path: str, ranks_path: str | None) -> "ChunkEncoder":
        if (path, ranks_path) not in _encoders:
            _encoders[path, ranks_path] = cls(path, ranks_path)
        return _encoders[path, ranks_path]

    def spans(self, group: tb.TextGroup) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the cores and joins of a group's texts, and how many spans lie before each text."""
        data, offsets = group.data, group.offsets
        first, last = offsets[:-1], offsets[1:]
        hashes = tb.SpanHashes(data.astype(np.uint64) + np.uint64(1), _POWERS).windows(ROLL)
        cuts = np.flatnonzero((hashes & np.uint64((1 << CUT_BITS) - 1)) == 0) + ROLL
        text = np.searchsorted(last, cuts, side="right")
        inside = text < len(last)
        cuts, text = cuts[inside], text[inside]
        inside = cuts - ROLL >= first[text]
        cuts, text = cuts[inside], text[inside]
        agree = np.flatnonzero((data[1:-1] == 32) & _PRINTABLE[data[:-2]] & _PRINTABLE[data[2:]]) + 1 if len(data) > 2 else np.zeros(0, np.int64)
        # not at either edge of a text, where its neighbour is another text's
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        agree = agree[~(edge[agree] | edge[agree + 1])]
        padded = np.concatenate([[-1], agree, [len(data)]])
        left = np.maximum(padded[np.searchsorted(padded, cuts, side="right") - 1], first[text])
        right = np.minimum(padded[np.searchsorted(padded, cuts, side="left")], last[text])
        ends = np.unique(np.concatenate([left, right, offsets]))
        return ends, np.searchsorted(ends, offsets)

    def encode(self, group: tb.TextGroup) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end and the ``len + 1`` bounds of the texts."""
        if self.bytes_kept > REMEMBERED_BYTES:
            self.forget()
            self.bytes_kept = 0
        if not len(group.data):
            return np.zeros(0, np.int32), np.zeros(len(group.rows) + 1, np.int64)
        ends, texts = self.spans(group)
        raw, cuts = group.data.tobytes(), ends.tolist()
        parts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        rare = np.add.reduceat((group.data > COMMON_BYTE).astype(np.int64), ends[:-1]) > 0
        at, missing = self.lookup(parts)
        if missing:
            new = list(dict.fromkeys([parts[i] for i in missing]))
            odd = {parts[i] for i in missing if rare[i]}
            coded = [self._ids(p, p in odd) for p in new]
            self.keep(new, np.concatenate(coded), np.array([len(c) for c in coded], np.int64))
            self.bytes_kept += sum(map(len, new))
            at[missing] = [self.index[parts[i]] for i in missing]
        ids, bounds = self.joined(at)
        return ids, bounds[texts]

    def _ids(self, part: bytes, odd: bool) -> np.ndarray:
        text = part.decode()
        if self.ranks is None or odd or any(s in part for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.ranks.encode_ordinary(text), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        sizes = self.piece_bounds[ids + 1] - self.piece_bounds[ids]
        upto = np.cumsum(sizes) - sizes
        where = np.repeat(self.piece_bounds[ids] - upto, sizes) + np.arange(int(sizes.sum()))
        return self.pieces[where].tobytes().decode("utf-8", "replace")


def _piece_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of every id end to end and their bounds, from a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    byte_of = {c: b for b, c in byte_letters().items()}
    pieces = {i: bytes(byte_of[c] for c in token) for token, i in told["model"]["vocab"].items()
              if all(c in byte_of for c in token)}
    pieces |= {t["id"]: t["content"].encode() for t in told["added_tokens"]}
    table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in table])])
    return np.frombuffer(b"".join(table), np.uint8), bounds


def _coded(path: str, ranks_path: str | None, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(path, ranks_path)
        for batch in batches:
            for group in tb.groups(batch.column("text")):
                ids, bounds = encoder.encode(group)
                rows = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                keys, sizes = batch.column("id").take(pa.array(group.rows)), pa.array(np.diff(bounds), pa.int64())
                decoded = [encoder.decode(r) for r in rows]
                if digests:
                    yield pa.RecordBatch.from_arrays([
                        keys, sizes, pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())],
                        ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([
                        keys, sizes, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                        pa.array(decoded, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return run


def encode_texts(df: DataFrame, path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 digests: bool = False) -> DataFrame:
    """Encode and decode every text: the id, ``n_tokens``, ``ids`` (array of int) and ``decoded``; or, with
    ``digests``, the SHA-256 of the little-endian 32-bit ids and of the decoded UTF-8 text instead.

    ``path`` is a byte-level BPE tokenizer file, ``ranks_path`` a rank file of the same vocabulary.
    """
    prepare(df.sparkSession)
    docs = pick(df, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.mapInArrow(_coded(path, ranks_path, digests), f"id {kind}, n_tokens long, {rest}").withColumnRenamed("id", id_col)
