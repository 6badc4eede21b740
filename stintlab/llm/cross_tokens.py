"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, over a whole corpus.

*Deduplication.* Rows are grouped by their full text, so every distinct text is tokenised and aligned once; its
pair counts carry the number of its copies, and its measures are joined to all ids that hold it (by the text's SHA-256).

*Alignment.* Both token sequences tile the bytes of ``space + text``. The ends of both cut the bytes into
segments; each segment lies in one A and one B token, and each overlapping pair shares exactly one segment, so the
links of a text are its segments. Where both end together a group closes. Both vocabularies cut at a space that follows
a printable ASCII character (tests compare with whole texts), so a worker encodes and aligns each distinct unit
between such spaces once and puts texts together from units.

*Counts.* Texts are dealt to chunks of some megabytes, each one row of a staged table: measures of its texts, the units
of each text, the pairs of each unit. The distinct pairs of chunks are summed over the corpus. Of the sums only those of
a chunk's own pairs come back to it, so a pair's count travels once a chunk and not once a link, and nothing that
grows with the corpus is held by one task or the driver.

Defined results: a null or empty text, or one whose tokens of either vocabulary don't spell out ``space + text``
(such as one with U+2581), has no tokens: zeros, an empty group text and no share in the counts. Special tokens'
strings are plain text. Repeated rows and ids come back as often as they came, null ids pass through, an empty
table gives an empty result, and extra columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import COMMON_BYTE, _piece_table
from .frames import pick, prepare, stage_at
from .tokens import Remembered, load_tokenizer

#: bytes of texts that make one chunk
CHUNK_BYTES = 4 << 20
#: a pair of ids as one number: a * B_IDS + b
B_IDS = 1 << 20
#: bytes of distinct units remembered by a worker before it starts afresh
REMEMBERED_BYTES = 4 << 20

_LAST_OF_WORD = np.zeros(256, bool)
_LAST_OF_WORD[0x21:0x7F] = True
_aligners: dict[tuple, "Aligner"] = {}


class Aligner(Remembered):
    """Tokens and links of text units. ``flat`` holds the pairs of all units known to the worker, end to end."""

    def __init__(self, a_path: str, a_ranks: str | None, b_path: str):
        super().__init__()
        import sentencepiece

        self.tokenizer, self.ranks = load_tokenizer(a_path), None
        self.tokenizer.encode_special_tokens = True
        if a_ranks:
            import public_tokenizers
            import tiktoken

            with open(a_ranks, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces, bounds = _piece_table(a_path)
        self.a_bytes = [pieces[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:])]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._b_piece(i) for i in range(len(self.b))]
        self.a_sizes, self.b_sizes = (np.array([len(p) for p in pieces]) for pieces in (self.a_bytes, self.b_bytes))
        # every id as text, followed by a comma, the bar after a group's last A token, the end after its last B token
        self.names = max(len(self.a_bytes), len(self.b_bytes))
        self.written = np.array([""] * self.names + [f"{i}{end}" for end in ",|;" for i in range(self.names)], object)

    def _b_piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(re.fullmatch("<0x([0-9A-F]{2})>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    @classmethod
    def of(cls, *paths) -> "Aligner":
        if paths not in _aligners:
            _aligners[paths] = cls(*paths)
        return _aligners[paths]

    def forget(self) -> None:
        super().forget()
        self.flat = np.zeros(4096, np.int64)
        self.told: list[str] = []  # groups of each unit as text, each with its end; empty if its tokens don't spell it out
        self.measures = np.zeros((1024, 3), np.int64)  # A tokens, B tokens, groups
        self.bytes_kept = 0

    def tokens(self, text: bytes, odd: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids in A and in B of a text that starts with a space; None if they don't spell it out."""
        told = text.decode()
        a = self.tokenizer.encode(told, add_special_tokens=False).ids if odd or self.ranks is None else self.ranks.encode_ordinary(told)
        # B puts a space before what it encodes; a lone space is not expressed by an empty text
        b = self.b.encode(told[1:], num_threads=1) if len(text) > 1 else [self.b.piece_to_id("▁")]
        if b"".join([self.a_bytes[i] for i in a]) != text or b"".join([self.b_bytes[i] for i in b]) != text:
            return None
        return np.array(a), np.array(b)

    def learn(self, units: list[bytes]) -> None:
        """Encode and align new units: those that end in printable ASCII end to end, as both vocabularies cut between them."""
        odd = [max(u) > COMMON_BYTE for u in units]
        joined = [i for i, u in enumerate(units) if _LAST_OF_WORD[u[-1]] and not odd[i]]
        coded = self.tokens(b"".join([units[i] for i in joined]), False) if joined else None
        if coded:
            self._keep([units[i] for i in joined], *coded)
        alone = sorted(set(range(len(units))) - set(joined)) if coded else range(len(units))
        for i in alone:
            coded = self.tokens(units[i], odd[i])
            if coded:
                self._keep([units[i]], *coded)
            else:
                self._add([units[i]], np.zeros((1, 3), np.int64), [""], np.zeros(0, np.int64), np.zeros(1, np.int64))

    def _keep(self, units: list[bytes], a: np.ndarray, b: np.ndarray) -> None:
        """Align the tokens of units that stand end to end and remember them by unit."""
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum([len(u) for u in units])
        links = np.union1d(a_ends, b_ends)  # ends of the segments
        common = np.intersect1d(a_ends, b_ends)
        i, j = np.searchsorted(a_ends, links), np.searchsorted(b_ends, links)
        per_unit = [np.diff(np.searchsorted(e, ends, side="right"), prepend=0) for e in (links, a_ends, b_ends, common)]
        # the groups as text: the A tokens of a group, then its B tokens, each with what follows it
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        upto_a, upto_b = np.searchsorted(a_ends, common, side="right"), np.searchsorted(b_ends, common, side="right")
        told = np.empty(len(a) + len(b), object)
        before_b = np.concatenate([[0], upto_b])[a_group]
        told[np.arange(len(a)) + before_b] = self.written[a + self.names * (1 + np.isin(a_ends, common))]
        told[np.arange(len(b)) + upto_a[b_group]] = self.written[b + self.names * (1 + 2 * np.isin(b_ends, common))]
        pieces, cuts = told.tolist(), np.concatenate([[0], np.cumsum(per_unit[1] + per_unit[2])]).tolist()
        told = ["".join(pieces[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        self._add(units, np.stack([per_unit[1], per_unit[2], per_unit[3]], axis=1), told, a[i].astype(np.int64) * B_IDS + b[j], per_unit[0])

    def _add(self, units: list[bytes], measures: np.ndarray, told: list[str], pairs: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.index)
        self._room_rows(known + len(units))
        self.measures[known:known + len(units)] = measures
        self.told += told
        self.keep(units, pairs, sizes)
        self.bytes_kept += sum(map(len, units))

    def _room_rows(self, need: int) -> None:
        if len(self.measures) < need:
            grown = np.zeros((max(need, 2 * len(self.measures)), 3), np.int64)
            grown[:len(self.measures)] = self.measures
            self.measures = grown

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts end to end, and the ``len + 1`` bounds of the texts."""
        if self.bytes_kept > REMEMBERED_BYTES:
            self.forget()
        parts: list[bytes] = []
        ends = [0]
        for text in texts:
            if text:
                raw = b" " + text
                data = np.frombuffer(raw, np.uint8)
                cuts = np.flatnonzero((data[1:] == 32) & _LAST_OF_WORD[data[:-1]]) + 1
                cuts = [0, *cuts.tolist(), len(raw)]
                parts += [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
            ends.append(len(parts))
        at, missing = self.lookup(parts)
        if missing:
            new = list(dict.fromkeys([parts[i] for i in missing]))
            for lo in range(0, len(new), 4096):
                self.learn(new[lo:lo + 4096])
            at[missing] = [self.index[parts[i]] for i in missing]
        return at, np.array(ends)


def _packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as compressed bytes (length first)."""
    raw = numbers.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()  # like bytes stand together
    return len(numbers).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


CHUNK = ("chunk long, digests array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
         "units binary, text_units binary, pairs array<long>, unit_pairs binary, unit_sizes binary, weights array<long>")


def _chunk(aligner: Aligner, number: int, digests: list[bytes], texts: list[bytes], copies: list[int]) -> pa.RecordBatch:
    at, bounds = aligner.units(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    # a text with a unit that is not spelled out has no tokens
    bad = np.zeros(len(texts), bool)
    bad[text_of[aligner.sizes[at] == 0]] = True
    at, text_of = at[~bad[text_of]], text_of[~bad[text_of]]
    sizes = np.bincount(text_of, minlength=len(texts))
    measures = np.zeros((len(texts), 3), np.int64)
    told = []
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
        if hi > lo:
            mine = at[lo:hi]
            measures[k] = aligner.measures[mine].sum(axis=0)
            told.append(hashlib.sha256("".join([aligner.told[u] for u in mine.tolist()])[:-1].encode()).hexdigest())
        else:
            told.append("")
    units, local = np.unique(at, return_inverse=True)
    times = np.zeros(len(units), np.int64)
    np.add.at(times, local, np.asarray(copies, np.int64)[text_of])
    flat, cuts = aligner.joined(units)
    pairs, where = np.unique(flat, return_inverse=True)
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, where, np.repeat(times, np.diff(cuts)))
    order = np.lexsort((local, text_of))  # units of a text in rising order, as steps
    steps = local[order].copy()
    steps[1:] -= np.where(text_of[order][1:] == text_of[order][:-1], local[order][:-1], 0)
    one = lambda value, kind: pa.array([value], kind)
    long = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([
        one(number, pa.int64()), one(digests, pa.list_(pa.binary())), *[one(measures[:, c], long) for c in range(3)],
        one(told, pa.list_(pa.string())), one(_packed(steps), pa.binary()), one(_packed(sizes), pa.binary()), one(pairs, long),
        one(_packed(where), pa.binary()), one(_packed(np.diff(cuts)), pa.binary()), one(weights, long)],
        ["chunk", "digests", "n_a", "n_b", "n_groups", "groups_sha256", "units", "text_units", "pairs", "unit_pairs", "unit_sizes", "weights"])


def _chunked(paths: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*paths)
        number = TaskContext.get().partitionId() << 32
        digests, texts, copies, held = [], [], [], 0
        for batch in batches:
            columns = [batch.column(c).cast(pa.large_binary()) for c in ("digest", "text")]
            for digest, text, times in zip(*columns, batch.column("copies").to_pylist()):
                digests.append(digest.as_py())
                texts.append(text.as_py())
                copies.append(times)
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield _chunk(aligner, number, digests, texts, copies)
                    number += 1
                    digests, texts, copies, held = [], [], [], 0
        if texts:
            yield _chunk(aligner, number, digests, texts, copies)

    return run


def _measured(chunk: pa.Table, counts: pa.Table) -> pa.Table:
    """Per text of a chunk its links, best links and the sum of their counts."""
    row = {c: chunk.column(c)[0] for c in chunk.column_names}
    pairs = row["pairs"].values.to_numpy()
    keys, links = counts.column("pair").to_numpy(), counts.column("links").to_numpy()
    at = np.searchsorted(pairs, keys)
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    count[at], best[at] = links, counts.column("best").to_numpy()
    where, sizes = _unpacked(row["unit_pairs"].as_py()), _unpacked(row["unit_sizes"].as_py())
    starts = np.cumsum(sizes) - sizes
    per_unit = [np.add.reduceat(v[where], starts) if len(starts) else np.zeros(0, np.int64) for v in (count, best)] + [sizes]
    steps, text_sizes = _unpacked(row["units"].as_py()), _unpacked(row["text_units"].as_py())
    units = np.zeros(len(steps), np.int64)
    first = np.cumsum(text_sizes) - text_sizes
    if len(steps):
        total = np.cumsum(steps)
        units = total - np.repeat(np.where(text_sizes > 0, total[np.minimum(first, len(total) - 1)] - steps[np.minimum(first, len(steps) - 1)], 0), text_sizes)
    sums = []
    for values in per_unit:
        upto = np.concatenate([[0], np.cumsum(values[units])])
        sums.append(upto[first + text_sizes] - upto[first])
    return pa.table([row["digests"].values, *[row[c].values for c in ("n_a", "n_b", "n_groups")],
                     *[pa.array(sums[k]) for k in (2, 1, 0)], row["groups_sha256"].values],
                    ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


MEASURES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Corpus-wide links of every id pair: ``a``, ``b``, ``links`` and ``best`` (1 where no other A id has more with this B id)."""
    pair = (chunks.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("weights").alias("weight"))))
            .groupBy("pair").agg(F.sum("weight").alias("links")))
    pair = pair.withColumn("b", F.col("pair") % B_IDS)
    top = pair.groupBy("b").agg(F.max("links").alias("top"))
    return pair.join(top, "b").select("pair", F.floor(F.col("pair") / B_IDS).alias("a"), "b", "links",
                                      (F.col("links") == F.col("top")).cast("long").alias("best"))


def aligned_chunks(df: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, text_col: str = "text") -> tuple[DataFrame, str]:
    """The staged table of aligned chunks (see ``CHUNK``) over the distinct non-empty texts, and its folder."""
    prepare(df.sparkSession)
    texts = (pick(df, text=text_col).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
             .select(_digest("text").alias("digest"), "text", "copies"))
    return stage_at(texts.mapInArrow(_chunked((a_path, a_ranks, b_path)), CHUNK), "chunks", compression="zstd")


def _digest(column: str):
    return F.unhex(F.sha2(column, 256))


def align_corpus(df: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is the most frequent of its B id,
    ties included), ``count_sum`` (corpus-wide counts over the row's links) and ``groups_sha256`` (the groups as
    ``a1,a2|b1;a3|b2,b3``, digested).

    ``a_path`` is a byte-level BPE file (``a_ranks``: a rank file of the same vocabulary, faster), ``b_path`` a
    sentencepiece model that puts a space first.
    """
    chunks, _ = aligned_chunks(df, a_path, b_path, a_ranks, text_col)
    counts = stage_at(pair_counts(chunks).select("pair", "links", "best"), "pairs", compression="zstd")[0]
    wanted = chunks.select(F.col("chunk").alias("home"), F.explode("pairs").alias("pair")).join(counts, "pair")
    names = [c.split()[0] for c in CHUNK.split(", ") if c.split()[0] != "weights"]
    measured = (chunks.select(*names).groupBy("chunk").cogroup(wanted.groupBy("home"))
                .applyInArrow(_measured, f"digest binary, {MEASURES}"))
    rows = pick(df, id=id_col, text=text_col).select("id", _digest("text").alias("digest"))
    columns = [c.split()[0] for c in MEASURES.split(", ")]
    return (rows.join(measured, "digest", "left")
            .select(F.col("id").alias(id_col), *[F.coalesce(F.col(c), F.lit("" if c == "groups_sha256" else 0)).alias(c) for c in columns]))
