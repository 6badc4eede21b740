"""Vector bin packing of token sequences by the dot-product heuristic.

An example has three demands: tokens, segments (one a piece) and loss-bearing tokens. The open
sequence keeps its remaining capacities ``r``; of the waiting pieces that fit all limits it takes the
one with the largest ``sum(w * r * demand)``, the dot product of what is left and what is asked, each
limit scaled to one and weighted by the waiting demand ``w``. If none fits, a piece may be cut so that
its front fills the sequence (``cut=True``), else the sequence is closed.

Every task packs the rows of its own partition while it reads them, with at most ``WAITING`` pieces in
memory, so there is no shuffle and no group. Examples longer than a limit are cut first. With ``cut``, a sequence
that stays short of the token limit (many short examples, a limit on segments or loss, the end of a partition) is cut
into sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text has the end id alone; a null id is kept as null; repeated rows
are packed as often as they come; an empty table gives an empty result; extra columns are ignored. Very
long texts are encoded whole (memory grows with the longest text of a task).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .frames import pick, prepare
from .tokens import WordEncoder

#: pieces that wait for a sequence in one task
WAITING = 512

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, segment long, loss_tokens long")


class Piece:
    """A run of one example's ids with the running count of its loss-bearing tokens."""

    __slots__ = ("example", "start", "ids", "loss", "tokens")

    def __init__(self, example, start: int, ids: np.ndarray, loss: np.ndarray, tokens: int):
        self.example, self.start, self.ids, self.loss, self.tokens = example, start, ids, loss, tokens

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, int(self.loss[-1] - self.loss[0])

    def front(self, tokens: int, loss: int) -> int:
        """Length of the longest front within both limits."""
        return min(tokens, int(np.searchsorted(self.loss, self.loss[0] + loss, side="right")) - 1, len(self.ids))

    def cut(self, at: int) -> tuple["Piece", "Piece"]:
        return (Piece(self.example, self.start, self.ids[:at], self.loss[:at + 1], self.tokens),
                Piece(self.example, self.start + at, self.ids[at:], self.loss[at:], self.tokens))


class Packer:
    """Streaming packer of one task. ``add`` and ``finish`` yield finished sequences (lists of pieces)."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool = True, waiting: int = WAITING):
        if min(tokens, segments, loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.cut, self.most = cut, waiting
        self.pieces: list[Piece | None] = [None] * waiting
        self.demand = np.full((waiting, 3), np.inf)
        self.free = list(range(waiting))

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        tokens, _, loss = self.limits.astype(int).tolist()
        # longer than a limit: whole fronts are sequences of their own
        while (fits := piece.front(tokens, loss)) < len(piece.ids):
            front, piece = piece.cut(fits)
            yield from self._place(front) if fits < tokens else [[front]]
        if len(piece.ids):
            yield from self._place(piece)

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        self._wait(piece)
        if not self.free:
            yield from self._close()

    def _wait(self, piece: Piece) -> None:
        slot = self.free.pop()
        self.pieces[slot], self.demand[slot] = piece, piece.demand()

    def _take(self, slot: int) -> Piece:
        piece, self.pieces[slot] = self.pieces[slot], None
        self.demand[slot] = np.inf
        self.free.append(slot)
        return piece

    def _fill(self) -> list[Piece]:
        left, sequence = self.limits.copy(), []
        there = np.isfinite(self.demand[:, 0])
        weights = self.demand[there].sum(axis=0) / self.limits**2
        while left[0] >= 1 and left[1] >= 1 and len(self.free) < self.most:
            fits = (self.demand <= left).all(axis=1)
            if fits.any():
                score = np.where(fits, np.where(fits[:, None], self.demand, 0) @ (weights * left), -1)
                piece = self._take(int(score.argmax()))
            elif self.cut and (slot := self._cuttable(left)) is not None:
                whole = self._take(slot)
                piece, rest = whole.cut(whole.front(int(left[0]), int(left[2])))
                self._wait(rest)
            else:
                break
            sequence.append(piece)
            left -= piece.demand()
            if left[1] == 1 and left[0] >= 1 and self.cut:  # the last segment: fill what is left at once
                longest = np.where(np.isfinite(self.demand[:, 0]), self.demand[:, 0], -1)
                slot = int(longest.argmax())
                if longest[slot] >= left[0] and (at := self.pieces[slot].front(int(left[0]), int(left[2]))) > 0:
                    whole = self._take(slot)
                    piece, rest = whole.cut(at)
                    if len(rest.ids):
                        self._wait(rest)
                    sequence.append(piece)
                    break
        return sequence

    def _cuttable(self, left: np.ndarray) -> int | None:
        """The longest waiting piece with a front that fits."""
        lengths = np.where(np.isfinite(self.demand[:, 0]), self.demand[:, 0], -1)
        for slot in np.argsort(-lengths)[:8].tolist():
            if lengths[slot] > 0 and self.pieces[slot].front(int(left[0]), int(left[2])) > 0:
                return slot
        return None

    def finish(self) -> Iterator[list[Piece]]:
        while len(self.free) < self.most:
            yield from self._close()

    def _close(self) -> Iterator[list[Piece]]:
        sequence = self._fill()
        if self.cut and sum(len(p.ids) for p in sequence) < self.limits[0]:
            yield from _powers_of_two(sequence)
        else:
            yield sequence


def _powers_of_two(sequence: list[Piece]) -> Iterator[list[Piece]]:
    """Cut a sequence along the binary digits of its length."""
    rest, total = list(sequence), sum(len(p.ids) for p in sequence)
    for bit in reversed(range(total.bit_length())):
        want = total & (1 << bit)
        part = []
        while want:
            piece = rest.pop(0)
            if len(piece.ids) > want:
                piece, after = piece.cut(want)
                rest.insert(0, after)
            part.append(piece)
            want -= len(piece.ids)
        if part:
            yield part


def _packed(path: str, end_id: int, limits: tuple[int, int, int], cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordEncoder.of(path), Packer(*limits, cut=cut)
        # ids stay below 2**63: 2**23 partitions of 2**40 sequences
        base, count, rows = TaskContext.get().partitionId() << 40, 0, []

        def keep(sequence: list[Piece]) -> None:
            nonlocal count
            offset = 0
            for segment, p in enumerate(sequence):
                rows.append((p.example, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.tokens,
                             base + count, offset, segment, int(p.loss[-1] - p.loss[0])))
                offset += len(p.ids)
            count += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[] for _ in SCHEMA.split(",")]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            ids, parts = batch.column("id").to_pylist(), batch.column("parts")
            flat = parts.flatten()
            bears = np.asarray(flat.field("loss").fill_null(False).cast(pa.uint8())).astype(bool)
            bounds = np.concatenate([[0], np.cumsum(np.asarray(parts.value_lengths().fill_null(0)))]).tolist()
            texts = flat.field("text")
            coded: list[np.ndarray] = []
            for group in tb.groups(texts):
                tokens, cuts = encoder.encode([group.text(i) for i in range(len(group.rows))])
                coded += [tokens[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            for example, lo, hi in zip(ids, bounds[:-1], bounds[1:]):
                tokens = np.concatenate([*coded[lo:hi], [end_id]]).astype(np.int32)
                mask = [np.full(len(c), b) for c, b in zip(coded[lo:hi], bears[lo:hi])]
                last = bool(bears[hi - 1]) if hi > lo else True
                loss = np.concatenate([[0], np.cumsum(np.concatenate([*mask, [last]]))])
                for sequence in packer.add(Piece(example, 0, tokens, loss, len(tokens))):
                    keep(sequence)
            if len(rows) > 4096:
                yield out()
        for sequence in packer.finish():
            keep(sequence)
        yield out()

    return run


def pack(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str | None = "text", parts_col: str | None = None,
         end_id: int = 2, tokens: int = 4096, segments: int = 1024, loss_tokens: int | None = None, cut: bool = True) -> DataFrame:
    """Pack examples into sequences within limits on tokens, segments and loss-bearing tokens.

    An example is a text (all its tokens bear loss) or, with ``parts_col``, an array of structs
    ``(text string, loss boolean)``, as for a prompt and its answer; the ids of the parts follow each
    other, then ``end_id`` (which bears loss as the last part does). One row per piece: the id,
    ``start`` and ``length`` within the example, ``ids_crc32``, ``doc_tokens`` (the example's, with the
    end id), ``sequence_id``, ``offset`` and ``segment`` within the sequence, and the piece's ``loss_tokens``.
    The tokenizer must be one that drops white space (see ``tokens.WordEncoder``).
    """
    prepare(df.sparkSession)
    if parts_col:
        rows = pick(df, id=id_col, parts=parts_col).select("id", F.expr(
            "transform(coalesce(parts, array()), p -> named_struct('text', p.text, 'loss', p.loss))").alias("parts"))
    else:
        rows = pick(df, id=id_col, text=text_col).select("id", F.array(F.struct("text", F.lit(True).alias("loss"))).alias("parts"))
    rows = rows.withColumn("id", F.col("id").cast("long"))
    packed = rows.mapInArrow(_packed(vocabulary_path, end_id, (tokens, segments, loss_tokens or tokens), cut), SCHEMA)
    return packed.withColumnRenamed("doc_id", id_col)
