"""Substring dedup by seed and extend over winnowed word anchors.

1. *Seeds.* Every run of ``min_words`` words contains ``w`` consecutive ``seed_words``-grams
   (``w = min_words - seed_words + 1``); the smallest of their hashes is the run's anchor
   (winnowing). Equal runs have equal anchors, so documents that share a run of at least
   ``min_words`` words share an anchor. Anchors of one document only are dropped by an
   aggregation of (anchor, document).
2. *Extend.* Documents with shared anchors are read again. Around each shared anchor the match is
   extended both ways to the ``min_words``-windows that it seeds; their span hashes are looked up in
   an aggregation that gives the first document of each window.
3. *Maximal repeats.* Adjoining windows that also start in an earlier document merge into spans
   of at least ``min_words`` words; ``remove_repeats`` cuts those spans.

Hot passages: within a task, windows are reduced to their earliest document per block of
``BLOCK_WINDOWS`` before the shuffle, so a passage that a third of all documents share reaches the
shuffle once per block, not once per document.

Defined results: null or short texts (fewer than ``min_words`` words) have no repeats; rows with a
null id neither remove nor lose words; rows that share an id do not remove each other's words;
repeated rows are returned as often as they came. Very long texts are processed whole (memory of
a task grows with its longest text). An empty table gives an empty result. Extra columns are ignored.
Hashes of windows have 96 bits (64 and an independent 32).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textbytes as tb
from .frames import prepare, stage

MIN_WORDS = 50
SEED_WORDS = 20
#: windows held by a task before it reduces and emits them
BLOCK_WINDOWS = 1 << 20

_POWERS = tb.WordPowers(0x9E3779B97F4A7C55)
_POWERS_2 = tb.WordPowers(0xC2B2AE3D27D4EB4F)


def _rolling_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (doubling steps)."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (w - span)], x[w - span:]) if w > span else x


def _group_anchors(group: tb.TextGroup, min_words: int, seed_words: int):
    """Span hashes of a group, with per text (index, first word, anchor of each of its windows)."""
    starts, ends, bounds = tb.word_spans(group.data, group.offsets)
    spans = tb.SpanHashes(tb.word_hashes(group.data, starts, ends), _POWERS)
    mins = spans.windows(seed_words)
    w = min_words - seed_words + 1
    mins = _rolling_min(mins, w) if len(mins) >= w else mins[:0]
    docs = [(i, lo, mins[lo:hi - min_words + 1])
            for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if hi - lo >= min_words]
    return starts, ends, bounds, spans, docs


def _changes(x: np.ndarray) -> np.ndarray:
    """The values where a run of equal values begins."""
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def _anchors(min_words: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for group in tb.groups(batch.column("text")):
                rows, found = [], []
                for i, _, mins in _group_anchors(group, min_words, seed_words)[-1]:
                    values = np.unique(_changes(mins))
                    found.append(values)
                    rows.append(np.full(len(values), group.rows[i]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tb.as_int64(np.concatenate(found))), ids.take(pa.array(np.concatenate(rows)))], ["anchor", "id"])

    return run


def _settle_block(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Of each window only the earliest document's rows go on to the shuffle; the others are settled.

    A waiting row has a place and the window's hashes. A settled row stands for ``h1`` adjoining windows
    from its place on that an earlier document has; its ``h2`` is null.
    """
    ids, at, h1, h2 = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, ids, h2, h1))
    ids, at, h1, h2 = (x[order] for x in (ids, at, h1, h2))
    head = np.ones(len(ids), bool)
    head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    waits = ids == ids[head][np.cumsum(head) - 1]
    names = ["id", "at", "h1", "h2"]
    yield pa.RecordBatch.from_arrays([pa.array(x[waits]) for x in (ids, at, h1, h2)], names)
    ids, at = ids[~waits], at[~waits]
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + 1)
    begin = np.flatnonzero(head)
    if len(begin):
        runs = at[np.append(begin[1:], len(ids)) - 1] - at[begin] + 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(at[begin]), pa.array(runs),
                                          pa.nulls(len(begin), pa.int32())], names)


def _windows(min_words: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            batch = batch.filter(batch.column("anchors").is_valid())
            wanted = batch.column("anchors")
            values = np.asarray(wanted.flatten(), dtype=np.int64).view(np.uint64)
            cuts = np.concatenate([[0], np.cumsum(np.asarray(wanted.value_lengths()))])
            ids, tags = np.asarray(batch.column("id")), np.asarray(batch.column("tag")).astype(np.int64) << 32
            for group in tb.groups(batch.column("text")):
                starts, ends, bounds, spans, docs = _group_anchors(group, min_words, seed_words)
                h1 = spans.windows(min_words)
                h2 = tb.SpanHashes(tb.word_hashes(group.data, starts, ends, seed=2), _POWERS_2).windows(min_words)
                for i, lo, mins in docs:
                    row = group.rows[i]
                    at = np.flatnonzero(np.isin(mins, values[cuts[row]:cuts[row + 1]]))
                    if len(at):
                        parts.append((np.full(len(at), ids[row]), tags[row] + at, tb.as_int64(h1[lo + at]),
                                      (h2[lo + at] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                        held += len(at)
                if held >= BLOCK_WINDOWS:
                    yield from _settle_block(parts)
                    parts, held = [], 0
        if parts:
            yield from _settle_block(parts)

    return run


def _rows(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """id, text, the carried columns as ``rest``, and ``tag``, a 31-bit hash of the text that tells rows apart
    that share an id."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"),
                     F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in carry]).alias("rest"))
    return docs.withColumn("tag", F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int"))


def repeat_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                 seed_words: int = SEED_WORDS, carry: list[str] | None = None) -> DataFrame:
    """Maximal word spans that also occur in a row with a smaller id.

    One row per id with such spans: ``id`` and ``spans``, ordered disjoint structs (``tag``, ``start``,
    ``stop``) in words; ``tag`` is the hash of the text that holds the span.
    """
    if not 0 < seed_words <= min_words:
        raise ValueError("seed_words must lie between 1 and min_words")
    prepare(df.sparkSession)
    docs = _rows(df, id_col, text_col, carry or [])
    seeds = stage(docs.where("id is not null").select("id", "text").mapInArrow(_anchors(min_words, seed_words), "anchor long, id long"), "seeds")
    shared = (seeds.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
              .where("lo < hi").select("anchor"))
    wanted = seeds.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    # rows without shared anchors pass through, so that this exchange of the texts is the one that
    # remove_repeats uses again; the task skips them
    # in one order, so that a task that runs again after a lost executor settles the same windows
    found = (docs.join(wanted.hint("shuffle_hash"), "id", "left").select("id", "tag", "text", "rest", "anchors")
             .sortWithinPartitions("id", "tag").mapInArrow(_windows(min_words, seed_words), "id long, at long, h1 long, h2 int"))
    # settled rows need no lookup; they are spread by their id
    by = Window.partitionBy("h1", "h2", F.when(F.col("h2").isNull(), F.col("id")))
    covered = (found.withColumn("first", F.min("id").over(by)).where("h2 is null or first < id")
               .select("id", "at", F.when(F.col("h2").isNull(), F.col("h1")).otherwise(1).alias("run")))
    return _merge(covered, min_words)


def _merge(covered: DataFrame, min_words: int) -> DataFrame:
    """Merge windows that overlap or adjoin. Places hold the tag above bit 32, so texts never merge."""
    order = Window.partitionBy("id").orderBy("at", "run")
    spans = covered.select("id", "at", "run", (F.col("at") + F.col("run") + (min_words - 1)).alias("stop"))
    spans = spans.withColumn("before", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("before").isNull() | (F.col("at") > F.col("before"))
    spans = spans.withColumn("part", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.lit(0xFFFFFFFF).cast("long")
    return (spans.groupBy("id", "part").agg(F.min("at").alias("start"), F.max("stop").alias("stop"))
            .select("id", F.struct(F.shiftright("start", 32).cast("int").alias("tag"),
                                   F.col("start").bitwiseAND(low).cast("int").alias("start"),
                                   F.col("stop").bitwiseAND(low).cast("int").alias("stop")).alias("span"))
            .groupBy("id").agg(F.sort_array(F.collect_list("span")).alias("spans")))


def _cut(as_is: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column("tag").to_pylist(), batch.column("spans").to_pylist())
            totals, removed, digests, kept = [], [], [], []
            for text, tag, cuts in rows:
                words = (text or "").encode().split()
                totals.append(len(words))
                gone = 0
                for cut in reversed(cuts or []):
                    if cut["tag"] == tag:
                        del words[cut["start"]:cut["stop"]]
                        gone += cut["stop"] - cut["start"]
                removed.append(gone)
                left = b" ".join(words)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(text if as_is and not gone else left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rest"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                ["id", "rest", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   seed_words: int = SEED_WORDS, carry: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """Every row's text without the words of its repeat spans.

    Columns: the id, the columns named in ``carry``, ``n_words``, ``n_removed``, ``kept_sha256`` (lowercase hex of
    the kept words joined by one space, in UTF-8) and ``kept_text`` (those words; with ``as_is`` a text that
    loses nothing stays as it was, white space included).
    """
    carry = carry or []
    clash = {id_col, "n_words", "n_removed", "kept_sha256", "kept_text"} & set(carry)
    if clash:
        raise ValueError(f"columns cannot be carried: {sorted(clash)}")
    spans = repeat_spans(df, id_col, text_col, min_words, seed_words, carry)
    rows = (_rows(df, id_col, text_col, carry).join(spans.hint("shuffle_hash"), "id", "left")
            .select("id", "tag", "text", "rest", "spans"))
    schema = (T.StructType().add("id", "long").add("rest", rows.schema["rest"].dataType).add("n_words", "long").add("n_removed", "long")
              .add("kept_sha256", "string").add("kept_text", "string"))
    out = rows.mapInArrow(_cut(as_is), schema)
    return out.select(F.col("id").alias(id_col), *[F.col(f"rest.`{c}`").alias(c) for c in carry], "n_words", "n_removed", "kept_sha256", "kept_text")
