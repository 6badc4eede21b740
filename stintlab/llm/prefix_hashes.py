"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds, for each of two primes, the running sums ``S[i] = sum (c_j + 1) * B**j mod p``.
The hash of any span ``[i, i + n)`` is ``(S[i + n] - S[i]) * B**-i mod p``: it does not depend on where
the span lies, so two spans are compared in constant time and the longest common extension of two
positions is a binary search over span equality.

A *fingerprint* is a string: the length, the hash of the whole text under both primes, and a sketch of all
``SPAN``-code-point spans: the smallest of their scrambled hashes in each of ``BINS`` bins. Equal texts have
equal fingerprints. ``likeness`` of two fingerprints is the share of equal bins among bins that either
fills, an estimate of the similarity of their span sets; 1.0 if all fields are equal.

Defined results: a null text counts as empty; two empty texts are alike (1.0), an empty and another text are
not (0.0); a text shorter than a span has itself as its only span. In ``edited_fingerprints`` rows are
ordered by id (nulls first), then text; the row after the last is the first, so a single row is its own
neighbour; rows are returned as often as they come; an empty table gives an empty result. Extra columns are
ignored. Very long texts are hashed whole (a task's memory grows with its longest text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick, prepare

#: primes below 2**31 (the first is a Mersenne prime, reduced by folding) and their bases
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525017)
SPAN = 16
BINS = 128
EMPTY = 0xFFFF
#: code points hashed together
GROUP_CHARS = 1 << 20

_U = np.uint64
_SCRAMBLE = _U(0x9E3779B97F4A7C15)
_tables: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """``B**0 .. B**(n-1)`` modulo the prime (or of the inverse base), doubled on demand."""
    p, table = PRIMES[which], _tables.get((which, inverse))
    base = pow(BASES[which], -1, p) if inverse else BASES[which]
    if table is None:
        table = np.ones(1, _U)
    while len(table) < n:
        table = np.concatenate([table, table * _U(pow(base, len(table), p)) % _U(p)])
    _tables[which, inverse] = table
    return table[:n]


def _mod(x: np.ndarray, which: int) -> np.ndarray:
    if which == 0:  # 2**31 = 1 modulo the Mersenne prime
        p = _U(PRIMES[0])
        x = (x & p) + (x >> _U(31))
        x = (x & p) + (x >> _U(31))
        return np.where(x >= p, x - p, x)
    return x % _U(PRIMES[which])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _prefix(points: np.ndarray, which: int) -> np.ndarray:
    """Running sums, not reduced (below 2**31 times the length)."""
    out = np.zeros(len(points) + 1, _U)
    np.cumsum(_mod((points.astype(_U) + _U(1)) * _powers(which, len(points)), which), out=out[1:])
    return out


def _span_hash(prefix: np.ndarray, start, stop, which: int, down: np.ndarray) -> np.ndarray:
    return _mod(_mod(prefix[stop] - prefix[start], which) * down[start], which)


class PrefixHashes:
    """Span equality and common extensions within and between texts."""

    def __init__(self, text: str):
        self.points = _code_points(text)
        self.prefixes = [_prefix(self.points, k) for k in (0, 1)]

    def __len__(self) -> int:
        return len(self.points)

    def span(self, start: int, n: int) -> tuple[int, int]:
        if start < 0 or n < 0 or start + n > len(self):
            raise IndexError("span outside the text")
        return tuple(int(_span_hash(self.prefixes[k], np.array([start]), np.array([start + n]), k, _powers(k, len(self) + 1, True))[0])
                     for k in (0, 1))

    def equal(self, start: int, other: "PrefixHashes", other_start: int, n: int) -> bool:
        return self.span(start, n) == other.span(other_start, n)

    def common_extension(self, start: int, other: "PrefixHashes", other_start: int) -> int:
        """Length of the longest common run from both positions: binary search over span equality."""
        low, high = 0, min(len(self) - start, len(other) - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _fingerprint_group(texts: list[str]) -> list[str]:
    points = _code_points("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    downs = [_powers(k, len(points) + 1, True) for k in (0, 1)]
    prefixes = [_prefix(points, k) for k in (0, 1)]
    whole = [_span_hash(prefixes[k], starts, ends, k, downs[k]) for k in (0, 1)]
    # all spans at once, without those that cross into the next text
    least = np.full(len(texts) * BINS, 1 << 30, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(np.arange(len(points)) + SPAN <= ends[owner]) if len(points) else np.zeros(0, np.int64)
    hashes = _span_hash(prefixes[0], at, at + SPAN, 0, downs[0])
    short = np.flatnonzero((sizes > 0) & (sizes < SPAN))
    hashes = np.concatenate([hashes, whole[0][short]])
    owner = np.concatenate([owner[at], short])
    scrambled = hashes * _SCRAMBLE
    slot = owner * BINS + (scrambled >> _U(64 - 7)).astype(np.int64)
    np.minimum.at(least, slot, ((scrambled >> _U(27)) & _U((1 << 30) - 1)).astype(np.int64))
    bins = np.where(least < 1 << 30, least % EMPTY, EMPTY).astype(">u2").reshape(len(texts), BINS)
    return [f"{n:x}.{a:08x}{b:08x}.{row.tobytes().hex()}"
            for n, a, b, row in zip(sizes.tolist(), whole[0].tolist(), whole[1].tolist(), bins)]


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of many texts, hashed in groups of about ``GROUP_CHARS`` code points."""
    out, group, size = [], [], 0
    for text in texts:
        if group and size + len(text) > GROUP_CHARS:
            out += _fingerprint_group(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    return out + (_fingerprint_group(group) if group else [])


def likeness(a: str, b: str) -> float:
    """Estimated similarity of two texts from their fingerprints alone, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(".", 1)[1]), ">u2") for f in (a, b))
    either = (x != EMPTY) | (y != EMPTY)
    return float(((x == y) & either).sum() / either.sum()) if either.any() else 0.0


def bucket_by_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Number rows by the id range they fall in, and add to each range its successor's first rows.

    ``docs`` has ``id`` and ``text``. Adds ``bucket`` and ``guest``: a guest row is a copy that only
    serves as the row after the last of its bucket. Range bounds are ids that exist (approximate
    quantiles; their number is ``buckets``, whatever the data), so the first row of the next range is
    known without a second pass.
    """
    shares = [k / buckets for k in range(buckets)]
    found = docs.agg(F.percentile_approx("id", shares, max(10_000, 10 * buckets)).alias("b"), F.min("id").alias("least")).first()
    bounds = sorted({found["least"], *found["b"]}) if found["b"] else [0]
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[::step]])
    # number of bounds up to the id: first among every step-th bound, then within that step
    block = F.size(F.filter(coarse, lambda b: b <= F.col("id")))
    within = F.size(F.filter(F.slice(every, F.greatest((block - 1) * step + 1, F.lit(1)), step), lambda b: b <= F.col("id")))
    number = F.when(F.col("id").isNull(), 1).otherwise((block - 1) * step + within)
    hosts = docs.withColumn("bucket", number)
    is_bound = F.element_at(every, F.col("bucket")) == F.col("id")
    first = F.col("id").isNull() | ((F.col("bucket") == 1) & is_bound)
    homes = F.filter(F.array(
        F.struct(F.col("bucket"), F.lit(False).alias("guest")),
        F.when(is_bound & (F.col("bucket") > 1), F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("guest"))),
        F.when(first, F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(True).alias("guest")))), lambda h: h.isNotNull())
    return hosts.select("id", "text", F.explode(homes).alias("h")).select("id", "text", "h.bucket", "h.guest")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row: id, text, bucket, guest, fingerprint
    for batch in batches:
        texts = batch.column("text").fill_null("").to_pylist()
        rows = list(zip(batch.column("id").to_pylist(), texts, batch.column("bucket").to_pylist(),
                        batch.column("guest").to_pylist(), fingerprints(texts)))
        rows = [held, *rows] if held else rows
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:]) if a[2] == b[2] and not a[3]]
        edited = [a[1][:len(a[1]) - len(a[1]) // 2] + b[1][:len(a[1]) // 2] for a, b in pairs]
        prints = fingerprints(edited)
        yield pa.RecordBatch.from_arrays([
            pa.array([a[0] for a, _ in pairs], pa.int64()),
            pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([a[4] for a, _ in pairs], pa.string()), pa.array(prints, pa.string()),
            pa.array([likeness(a[4], p) for (a, _), p in zip(pairs, prints)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
        ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, whose last half (rounded down) is replaced by as much of
    the front of the next row's text; with the likeness of the fingerprint to both neighbours'."""
    spark = df.sparkSession
    prepare(spark)
    docs = pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = bucket_by_order(docs, 2 * partitions)
    ordered = (placed.repartition(partitions, "bucket")
               .sortWithinPartitions("bucket", "guest", F.asc_nulls_first("id"), F.asc_nulls_first("text")))
    out = ordered.mapInArrow(_edited, "id long, n_chars long, edited_sha256 string, fingerprint string, "
                                      "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _fingerprint_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").fill_null("").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(texts), pa.string())], ["id", "fingerprint"])


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One ``fingerprint`` per row, without a shuffle."""
    prepare(df.sparkSession)
    docs = pick(df, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_fingerprint_texts, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_common_extension(df: DataFrame, left: Column, right: Column, left_at: Column, right_at: Column, name: str = "extension") -> DataFrame:
    """Add the length of the longest common run of two texts from given positions (null if an input is null)."""
    prepare(df.sparkSession)

    @F.pandas_udf("long")
    def extend(a: pd.Series, b: pd.Series, i: pd.Series, j: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or pd.isna(p) or pd.isna(q) else
                          PrefixHashes(x).common_extension(int(p), PrefixHashes(y), int(q)) for x, y, p, q in zip(a, b, i, j)], dtype="Int64")

    return df.withColumn(name, extend(left, right, left_at.cast("long"), right_at.cast("long")))
