"""Cross-entropy difference: score documents by matched target and background bigram models.

Both models are interpolated bigram models of the same form over one vocabulary: all words of the corpus, and one
mark for the edge of a text (before its first word and after its last). With ``c`` the counts of one model over
its texts, ``N`` its events (words and ends) and ``|V|`` the words of the corpus,

    p(w)     = (c(w) + 1) / (N + |V| + 2)
    p(w | h) = LAMBDA * c(h w) / c(h)  +  (1 - LAMBDA [c(h) > 0]) * p(w)

and the loss of a word is ``-ln p(w | h)``. A document's score is the mean over its words and its end of
the target loss minus the background loss; lower is closer to the target.

No word and no bigram is left out, so the model grows with the corpus and is never collected or broadcast. Texts
are dealt over chunks of about ``CHUNK`` events by the hash of their id and text. A chunk counts its words and bigrams,
sorts their 64-bit hashes and sends them to key ranges, one block of gaps and counts a range. A range adds up
the counts of all chunks and answers each block with the corpus counts of its keys, in the block's order. The answers
need no keys: the chunk sorts its words and bigrams again and reads the counts off in order. A word or bigram
thus crosses the network once a chunk in about six bytes, and its count comes back in a fraction of one. Where chunks and
ranges are so many that blocks hold few keys, a block is a row of a few keys; there are never more blocks than keys.

Words are the runs of ``[^\\x20\\x09-\\x0D]``, A-Z in lower case; words and bigrams are handled as 64-bit hashes.

Defined results: null and empty texts have no words and are scored on their end alone; rows with a null id are
scored but are never target texts; repeated rows count and are returned as often as they come; with no target
texts the target model is uniform; an empty table gives an empty result; extra columns are ignored. Whole
texts are used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .frames import pick, prepare, stage
from .textbytes import U

LAMBDA = 0.75
#: words a task holds before it emits the distinct ones
HELD = 1 << 20
#: events (words and ends of texts) in a chunk of texts that are counted and scored together, on average
CHUNK = 1 << 20
#: keys of all chunks that meet in a range, at most on average
RANGE = 1 << 21

#: stands for the edge of a text, beside the hashes of words
EDGE = U(1)
#: bytes of a gap that are sent as they are; its upper bytes and the counts are mostly zero and compressed
LOW = 5


def _planes(values: np.ndarray, kind: str) -> np.ndarray:
    """The bytes of ``values``, lowest first: a row for each byte of the type."""
    return values.astype(kind).view(np.uint8).reshape(len(values), -1).T


def _from_planes(planes: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def encode_block(base: int, keys: np.ndarray, target: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending ``keys`` from ``base`` on with their two counts."""
    gaps = _planes(np.diff(keys, prepend=U(base)), "<u8")
    rest = [gaps[LOW:], _planes(target, "<u4"), _planes(n, "<u4")]
    return gaps[:LOW].tobytes(), zlib.compress(b"".join(p.tobytes() for p in rest), 1)


def decode_block(base: int, low: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = len(low) // LOW
    others = np.frombuffer(zlib.decompress(rest), np.uint8).reshape(-1, size)
    gaps = np.concatenate([np.frombuffer(low, np.uint8).reshape(LOW, size), others[:8 - LOW]])
    target, n = others[8 - LOW:12 - LOW], others[12 - LOW:]
    return U(base) + np.cumsum(_from_planes(gaps, "<u8"), dtype=U), _from_planes(target, "<u4"), _from_planes(n, "<u4")


def _grouped(batches: Iterator[pa.RecordBatch]):
    """(batch, group, word hashes, bounds of the words of each text)."""
    for batch in batches:
        for group in tb.groups(batch.column("text")):
            data = tb.ASCII_LOWER[group.data]
            starts, ends, bounds = tb.word_spans(data, group.offsets)
            yield batch, group, tb.word_hashes(data, starts, ends), bounds


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with its events ``n`` for each text, and a row with its ``key`` for each distinct word held."""
    held, size = [], 0

    def distinct(kind: pa.DataType) -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        none = [pa.nulls(len(keys), t) for t in (kind, pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(tb.as_int64(keys))], ["id", "hash", "n", "key"])

    kind = None
    for batch, group, words, bounds in _grouped(batches):
        at, kind = pa.array(group.rows), batch.column("id").type
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), batch.column("hash").take(at), pa.array(np.diff(bounds) + 1), pa.nulls(len(at), pa.int64())],
            ["id", "hash", "n", "key"])
        held.append(np.unique(words))
        size += len(held[-1])
        if size > HELD:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
            if 2 * size > HELD:
                yield distinct(kind)
                held, size = [], 0
    if size:
        yield distinct(kind)


class Chunk:
    """The events of a chunk's texts and the sorted ``keys`` of their words and bigrams.

    ``texts`` has the rows to score and a row without ``scored`` for each id that is a target text.
    """

    def __init__(self, texts: pa.Table):
        marks = texts.filter(pc.invert(texts.column("scored"))).column("id")
        rows = texts.filter(texts.column("scored"))
        ids, lengths, events, before, target = [], [], [], [], []
        for batch, group, words, bounds in _grouped(rows.to_batches()):
            found = batch.column("id").take(pa.array(group.rows))
            limits = bounds + np.arange(len(bounds))
            step = np.insert(words, bounds[1:], EDGE)
            last = np.empty_like(step)
            last[1:] = step[:-1]
            last[limits[:-1]] = EDGE
            hit = np.asarray(pc.is_in(found, value_set=marks.combine_chunks()).cast(pa.uint8()))
            ids.append(found)
            lengths.append(np.diff(bounds))
            events.append(step)
            before.append(last)
            target.append(np.repeat(hit, np.diff(limits)))
        self.ids, self.lengths = pa.chunked_array(ids, texts.schema.field("id").type), np.concatenate([np.zeros(0, np.int64), *lengths])
        events, before = (np.concatenate([np.zeros(0, U), *x]) for x in (events, before))
        self.target = np.concatenate([np.zeros(0, np.uint8), *target])
        pairs = tb.mix64(before * U(0x9E3779B97F4A7C15) + events)
        self.keys, where = np.unique(np.concatenate([events, pairs]), return_inverse=True)
        self.events, self.pairs = where[:len(events)], where[len(events):]
        # the event before each is the one before it in its text, or the edge
        edge = np.searchsorted(self.keys, EDGE)
        self.before = np.roll(self.events, 1)
        self.before[self.starts()] = edge

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths + 1) - self.lengths - 1

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        where = np.concatenate([self.events, self.pairs])
        return (np.bincount(where, weights=np.tile(self.target, 2), minlength=len(self.keys)).astype(np.int64),
                np.bincount(where, minlength=len(self.keys)))


def _blocks(bits: int):
    """The counts of a chunk, cut into ``2**bits`` ranges of keys."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        chunk, rows = Chunk(texts), []
        target, n = chunk.counts()
        parts, starts = np.unique(chunk.keys >> U(64 - bits), return_index=True)
        for part, lo, hi in zip(parts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(chunk.keys)]):
            rows.append((part, key[0].as_py(), *encode_block(part << (64 - bits), chunk.keys[lo:hi], target[lo:hi], n[lo:hi])))
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "chunk", "low", "rest"])

    return run


def _answers(bits: int):
    """The corpus counts of a range's keys for each chunk's block, in the block's order."""

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        base = key[0].as_py() << (64 - bits)
        found = [decode_block(base, a, b) for a, b in zip(blocks.column("low").to_pylist(), blocks.column("rest").to_pylist())]
        keys, target, n = (np.concatenate(x) for x in zip(*found))
        _, where = np.unique(keys, return_inverse=True)
        both = np.stack([np.bincount(where, weights=x)[where].astype(np.int64) for x in (target, n)])
        ends = np.cumsum([len(k) for k, _, _ in found]).tolist()
        totals = [zlib.compress(b"".join(_planes(row[lo:hi], "<i8").tobytes() for row in both), 1) for lo, hi in zip([0, *ends], ends)]
        return pa.table([blocks.column("part"), blocks.column("chunk"), pa.array(totals, pa.binary())], ["part", "chunk", "totals"])

    return run


def _scored(size: np.ndarray):
    """``size`` is ``N + |V| + 2`` of the target (row 0) and the background model (row 1)."""

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(texts)
        order = answers.column("part").to_numpy().argsort().tolist()
        totals = answers.column("totals").to_pylist()
        read = [np.frombuffer(zlib.decompress(totals[k]), np.uint8) for k in order]
        n = np.concatenate([np.stack([_from_planes(p, "<i8") for p in x.reshape(2, 8, -1)]) for x in read] or [np.zeros((2, 0))], axis=1)
        if n.shape[1] != len(chunk.keys):
            raise RuntimeError(f"{n.shape[1]} counts for {len(chunk.keys)} words and bigrams of chunk {key[0]}")
        loss = np.zeros((2, len(chunk.lengths)))
        if len(chunk.lengths):
            h, w, p = (n[:, x].astype(np.float64) for x in (chunk.before, chunk.events, chunk.pairs))
            seen = np.maximum(h, 1)
            each = -np.log(LAMBDA * p / seen + (1 - LAMBDA * h / seen) * (w + 1) / size)
            loss = np.add.reduceat(each, chunk.starts(), axis=1) / (chunk.lengths + 1)
        return pa.table([chunk.ids, pa.array(chunk.lengths), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[0] - loss[1])],
                        ["id", "n_words", "target_loss", "background_loss", "ce_difference"])

    return run


def score(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_words``, mean ``target_loss`` and ``background_loss``, and their difference
    ``ce_difference``. ``target_ids`` has the ids of the target texts in its first column."""
    prepare(df.sparkSession)
    docs = pick(df, id=id_col, text=text_col).withColumn("hash", F.xxhash64("id", "text"))
    kind = docs.schema["id"].dataType.simpleString()
    sizes = stage(docs.mapInArrow(_sizes, f"id {kind}, hash long, n long, key long"), "sizes")
    texts = sizes.where("key is null")
    wanted = target_ids.select(F.col(f"`{target_ids.columns[0]}`").alias("id")).where("id is not null").distinct()
    # one plan at every size: the ids grow with the corpus, so they are never broadcast
    hits = stage(texts.select("id", "hash", "n").join(wanted.hint("shuffle_hash"), "id"), "targets")
    words = sizes.where("key is not null").agg(F.countDistinct("key").alias("n")).first()["n"]
    target, n = (d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for d in (hits, texts))
    size = np.array([[target], [n]], np.float64) + words + 2
    # words and bigrams of all chunks: two an event at most
    bits = max(1, (2 * n // RANGE).bit_length())
    chunk = F.pmod(F.col("hash"), F.lit(n // CHUNK + 1)).alias("chunk")
    rows = docs.select(chunk, "id", "text", F.lit(True).alias("scored"))
    marks = hits.select(chunk, "id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("scored")).distinct()
    dealt = rows.union(marks).groupBy("chunk")
    blocks = dealt.applyInArrow(_blocks(bits), "part long, chunk long, low binary, rest binary")
    answers = blocks.groupBy("part").applyInArrow(_answers(bits), "part long, chunk long, totals binary")
    out = dealt.cogroup(answers.groupBy("chunk")).applyInArrow(
        _scored(size), f"id {kind}, n_words long, target_loss double, background_loss double, ce_difference double")
    return out.withColumnRenamed("id", id_col)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS hit
  FROM documents),
flat AS (SELECT r, hit, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs),
vocabulary AS (SELECT word FROM flat GROUP BY word),
events AS (
  SELECT r, hit, i, 'w' || word AS w FROM flat
  UNION ALL SELECT r, hit, len(words) + 1, '#end' FROM docs),
steps AS (SELECT r, hit, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), '#start') AS h FROM events),
single AS (SELECT w, count(*) FILTER (hit) AS t, count(*) AS b FROM steps GROUP BY w),
size AS (SELECT count(*) FILTER (hit) AS t, count(*) AS b FROM steps),
classes AS (SELECT count(*) + 2 AS k FROM vocabulary),
alone AS (SELECT w, (single.t + 1) / (size.t + k)::DOUBLE AS t, (single.b + 1) / (size.b + k)::DOUBLE AS b FROM single, size, classes),
history AS (SELECT h, count(*) FILTER (hit) AS t, count(*) AS b FROM steps GROUP BY h),
pairs AS (SELECT h, w, count(*) FILTER (hit) AS t, count(*) AS b FROM steps GROUP BY h, w),
covered AS (SELECT h, sum(t) AS t, sum(b) AS b FROM pairs GROUP BY h),
loss AS (
  SELECT r,
    -ln(0.75 * coalesce(p.t, 0) / greatest(y.t, 1) + (1 - 0.75 * coalesce(c.t, 0) / greatest(y.t, 1)) * a.t) AS t,
    -ln(0.75 * coalesce(p.b, 0) / greatest(y.b, 1) + (1 - 0.75 * coalesce(c.b, 0) / greatest(y.b, 1)) * a.b) AS b
  FROM steps s JOIN alone a USING (w) JOIN history y USING (h) LEFT JOIN covered c USING (h) LEFT JOIN pairs p USING (h, w)),
scores AS (SELECT r, avg(t) AS t, avg(b) AS b, avg(t - b) AS d FROM loss GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(d, 6) AS ce_difference
FROM docs JOIN scores USING (r)
"""
