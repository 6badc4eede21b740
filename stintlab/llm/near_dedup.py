"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

*Sketch.* A document's set holds the hashes of its distinct word shingles. Round ``i`` of the first
``t`` rounds hashes every element to one of ``t`` bins and keeps the smallest value in each bin that
earlier rounds left empty; round ``t + i`` sends all elements to bin ``i``, so every coordinate fills
after at most ``2t`` rounds. Two sets agree in a coordinate with probability equal to their Jaccard
similarity, and the share of equal coordinates concentrates as with independent MinHash, while a set of
``n`` elements costs about ``n + t log t`` steps instead of ``n t``.

*Candidates.* Coordinates are cut into bands; documents that agree in a whole band share a bucket.
With 32 bands of 4 a pair at similarity 0.8 shares none with probability 5e-8.

*Links.* Documents with equal sets form one class first, so copies never meet in pairs. Each bucket has a
hub, its class with the largest buckets in all, which in a group of edited copies is the text they were
edited from. Each class is compared with the hub it shares most buckets with; verified links give components.
Only buckets that still hold several components go on: there each member outside the bucket's largest
component may still link to members of other components. Pairs inside one component need no comparison, as
they cannot change the result. Members near the component's centre ``H`` carry their set as differences from
it, ``H \\ A`` and ``A \\ H``, which give the exact intersection of two members within the join,
``|H| - |(H \\ A) u (H \\ B)| + |(A \\ H) n (B \\ H)|``; so of a large group of edited copies only links leave the
join. Other pairs are dropped only if their sketches agree in under 75 of 128 coordinates (six standard
deviations below 0.8). Every link is verified on the full sets: ``100 * intersection >= percent * union``.

Defined results: a text with fewer words than a shingle forms one shingle of all its words; null and
empty texts (or only white space) have an empty set and link with nothing; rows with a null id link
with nothing and are kept; rows that share an id count as one document; an empty table gives an
empty result. Texts are used whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .frames import pick, prepare, stage

COORDINATES = 128
BAND_ROWS = 4
#: a pair whose sketches agree in fewer coordinates is not compared (0.8 lies six deviations above)
LEAST_AGREEING = 75

_U = np.uint64
_SEEDS = tb.coefficients(2 * COORDINATES, 77)
_ROUNDS = tb.coefficients(2 * COORDINATES, 1234)
_BAND_MIX = tb.coefficients(COORDINATES, 991)
_SET_MIX = tb.coefficients(2, 5)


def shingle_sets(group: tb.TextGroup, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text end to end, and their ``len + 1`` bounds."""
    data = tb.ASCII_LOWER[group.data]
    starts, ends, bounds = tb.word_spans(data, group.offsets)
    hashes = tb.word_hashes(data, starts, ends)
    mixing = tb.coefficients(words_each, 31)
    n = len(hashes) - words_each + 1
    runs = np.zeros(max(n, 0), _U)
    for j in range(words_each if n > 0 else 0):
        runs += hashes[j:j + n] * mixing[j]
    runs = tb.mix64(runs)
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words_each:
            sets.append(np.unique(runs[lo:hi - words_each + 1]))
        elif hi > lo:  # the whole sequence, marked with its length
            short = (hashes[lo:hi] * mixing[:hi - lo]).sum(dtype=_U)
            sets.append(tb.mix64(np.array([short], _U) ^ _U(hi - lo)))
        else:
            sets.append(np.zeros(0, _U))
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(sizes)])


def sketch(elements: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of many sets at once: one row of ``t`` coordinates per non-empty set
    (rows of empty sets hold no meaning)."""
    n = len(bounds) - 1
    coordinates = np.zeros((n, t), _U)
    filled = np.zeros((n, t), bool)
    flat, flat_filled = coordinates.reshape(-1), filled.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    live = elements
    none = _U(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * t):
        if not len(live):
            break
        h = tb.mix64(live ^ _SEEDS[i])
        at = owner * t + ((h & _U(t - 1)).astype(np.int64) if i < t else i - t)
        open_ = ~flat_filled[at]
        at, value = at[open_], h[open_] >> _U(8)
        least = np.unique(at)
        slot = np.searchsorted(least, at)
        best = np.full(len(least), none)
        np.minimum.at(best, slot, value)
        flat[least] = tb.mix64(best + _ROUNDS[i])
        flat_filled[least] = True
        unfinished = ~filled.all(axis=1)[owner]
        live, owner = live[unfinished], owner[unfinished]
    return coordinates


def _sketched(words_each: int):
    bands = COORDINATES // BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in tb.groups(batch.column("text")):
                elements, bounds = shingle_sets(group, words_each)
                sizes = np.diff(bounds)
                some = sizes > 0
                rows = sketch(elements, bounds)
                keys = (rows * _BAND_MIX).reshape(len(sizes), bands, BAND_ROWS).sum(axis=2, dtype=_U)
                keys = tb.mix64(keys + np.arange(bands, dtype=_U) * _U(0xD6E8FEB86659FD93))
                sums = np.zeros((2, len(sizes)), _U)
                if some.any():
                    for s, k in zip(sums, _SET_MIX):
                        s[some] = np.add.reduceat(tb.mix64(elements ^ k), bounds[:-1][some])
                cut = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(group.rows)), pa.array(sizes),
                    pa.array(tb.as_int64(sums[0])), pa.array(tb.as_int64(sums[1])),
                    pa.ListArray.from_arrays(pa.array(cut * np.int32(bands)), pa.array(tb.as_int64(keys[some]).reshape(-1))),
                    pa.ListArray.from_arrays(pa.array(cut * np.int32(COORDINATES)),
                                             pa.array(rows[some].astype(np.uint16).view(np.int16).reshape(-1))),
                ], ["id", "n", "s1", "s2", "bands", "sketch"])

    return run


def _sets(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in tb.groups(batch.column("text")):
                elements, bounds = shingle_sets(group, words_each)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(group.rows)),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tb.as_int64(elements)))],
                    ["id", "elements"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, words_each: int) -> DataFrame:
    """Full sets of the texts with these ids: ``id``, ``elements``."""
    return stage(docs.join(ids, "id", "left_semi").mapInArrow(_sets(words_each), "id long, elements array<long>"), "sets")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. ``b`` may be a hub of many ``a``."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return (both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
            .where((F.col("common") * 100 >= percent * (F.col("total") - F.col("common"))) & (F.col("common") > 0))
            .select("a", "b").distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row: the id, ``n_shingles`` (set size), ``component_id`` (smallest id reachable over links,
    itself included; null for a null id) and ``kept`` (the id is its component's, or is null)."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 80 percent or more")
    prepare(df.sparkSession)
    docs = pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    seen = stage(docs.mapInArrow(_sketched(words_each),
                                 "id long, n long, s1 long, s2 long, bands array<long>, sketch array<smallint>"), "sketches")
    key = ["n", "s1", "s2"]
    classes = seen.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"))
    member = stage(seen.select("id", *key).join(classes, key, "left")
                   .select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), "members")
    reps = stage(seen.where("n > 0").join(classes.select(*key, F.col("rep").alias("id")), [*key, "id"], "left_semi")
                 .select("id", "bands", "sketch"), "classes")

    entries = reps.select("id", F.explode("bands").alias("bucket")).distinct()
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(entries.join(sizes, "bucket"), "buckets")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = (shared.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("m"))).alias("top"))
            .select("bucket", (-F.col("top.m")).alias("hub")))
    stars = shared.join(hubs, "bucket").where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = stage(stars.groupBy("id").agg(F.max(F.struct("times", (-F.col("hub")).alias("m"))).alias("top"))
                 .select(F.col("id").alias("a"), (-F.col("top.m")).alias("b")), "stars")
    ends = stage(best.select(F.col("a").alias("id")).union(best.select("b")).distinct(), "ends")
    links = stage(_verified(_sets_of(docs, ends, words_each), best, percent), "links")
    one_id = (member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
              .where("a < b").select("a", "b"))
    links = stage(links.union(one_id), "links")

    links = links.union(_across(docs, shared.select("bucket", "id"), reps, components(links), words_each, percent))
    roots = components(links).withColumnsRenamed({"node": "rep"})
    return (member.join(roots, "rep", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("root", "rep", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))


def _across(docs: DataFrame, shared: DataFrame, reps: DataFrame, labels: DataFrame, words_each: int, percent: int) -> DataFrame:
    """Verified links between different components, from the buckets that hold several."""
    named = (shared.join(labels.withColumnsRenamed({"node": "id"}), "id", "left")
             .select("bucket", "id", F.coalesce("root", "id").alias("root")))
    mixed = (named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo < hi").select("bucket"))
    left = stage(named.join(mixed, "bucket"), "mixed")
    main = (left.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("top")).select("bucket", F.col("top.root").alias("main")))
    full = stage(left.join(main, "bucket"), "mixed")
    sets = _sets_of(docs, stage(full.select("id").distinct(), "ends"), words_each)
    # the centre of a largest component is its member in most of these buckets
    centre = (full.where("root = main").groupBy("main", "id").agg(F.count(F.lit(1)).alias("c"))
              .groupBy("main").agg(F.max(F.struct("c", (-F.col("id")).alias("m"))).alias("top")).select("main", (-F.col("top.m")).alias("id")))
    centre = stage(centre.join(sets, "id").dropDuplicates(["main"]).select("main", F.col("elements").alias("h")), "centres")
    member = full.select("main", "id").distinct().join(sets, "id").join(reps.select("id", "sketch"), "id").join(centre, "main")
    lacks, adds = F.array_except("h", "elements"), F.array_except("elements", "h")
    member = member.select("main", "id", "sketch", F.size("elements").alias("n"), F.size("h").alias("hn"), lacks.alias("lacks"), adds.alias("adds"))
    near = (F.col("hn") - F.size("lacks")) * 2 >= F.col("hn") + F.size("adds")  # similarity to the centre of a half
    member = stage(member.select("main", "id", "sketch", "n", "hn", *[F.when(near, F.col(c)).alias(c) for c in ("lacks", "adds")]), "members")
    known = full.join(member, ["main", "id"])
    names = ("id", "root", "sketch", "n", "lacks", "adds")
    small = known.where("root <> main").select("bucket", "main", "hn", *[F.col(c).alias(c + "1") for c in names])
    other = known.select("bucket", *[F.col(c).alias(c + "2") for c in names])
    agreeing = F.size(F.filter(F.zip_with("sketch1", "sketch2", lambda x, y: x == y), lambda same: same))
    both_lack = F.size("lacks1") + F.size("lacks2") - F.size(F.array_intersect("lacks1", "lacks2"))
    common = F.col("hn") - both_lack + F.size(F.array_intersect("adds1", "adds2"))
    total = F.col("n1") + F.col("n2")
    links = F.when(F.col("lacks1").isNotNull() & F.col("lacks2").isNotNull(), common * (100 + percent) >= percent * total) \
        .otherwise(agreeing >= LEAST_AGREEING)
    pairs = (small.join(other, "bucket")
             .where((F.col("root1") != F.col("root2")) & ((F.col("root2") == F.col("main")) | (F.col("id1") < F.col("id2")))
                    & (F.least("n1", "n2") * (100 + percent) >= percent * total) & links)
             .select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct())
    return _verified(sets, stage(pairs, "pairs"), percent)
