"""N-gram Jaccard self-join: size-aware, with subsets for small sets and inverted lists for large ones.

*Sets.* A document's set holds the hashes of its distinct word shingles. Documents with equal sets form one class, so
copies never meet in pairs; all that follows compares one representative a class.

*Order.* With similarity ``t``, two sets in one global order of elements share at least ``k`` of their first
``n - ceil(t n) + k`` elements. The order is by hash, with the elements that stand in the beginnings of many sets
put last, so that common lines and passages rarely come into a beginning. Any order gives all pairs; this one
gives short lists. A scan keeps a set's beginning and a reserve beyond it; sets whose reserve is used up by
elements put last are ordered once more as a whole.

*Size-aware join.* Sets of at most ``x`` elements emit the 2-subsets of their beginnings (``k = 2``); two of them are
candidates if they emit a common subset. Larger sets scan the inverted lists of the elements of their beginnings
(``k = 1``), which hold all sets large enough to be similar to one of them. ``x`` is the size class with the
least cost: subsets emitted up to it plus list entries scanned beyond it, both counted exactly. A pair counts where it
meets only if the places of what it shares leave room for enough common elements.

*Links.* Candidates whose reserves already rule the similarity out are dropped by an exact bound, the others verified
on full sets: ``100 * intersection >= percent * union``. ``similar_pairs`` returns all links between
representatives. ``join_components`` needs only the components, and takes less for large groups of near copies:

1. Each set is compared with its leader, the set with the longest lists among those it meets.
2. Sets near the same leader H are kept as differences from it. Two of them that are similar, but not both linked
   with H, share an element of these differences: otherwise ``|A ^ B| = |A ^ H| + |B ^ H|``, and whatever keeps that small
   keeps both close enough to H. So they are joined on (H, element of the difference), where the copies' common
   text no longer occurs, and ``|A ^ B| = |dA| + |dB| - 2 |dA n dB|`` decides within the join.
3. Other pairs come from the lists, without those of one leader or one component.

Defined results: a text with fewer words than a shingle has one shingle of all its words; null and empty texts (or
only white space) have an empty set and link with nothing; rows with a null id link with nothing and are kept;
rows that share an id count as one document; an empty table gives an empty result. Texts are used whole. Ids
are cast to long. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .frames import pick, prepare, stage
from .near_dedup import shingle_sets

#: an element in the reserves of more sets than this comes last in the order
FREQUENT = 32
#: classes of set sizes by which costs are added up: this many for each doubling
CLASSES = 4
#: cost of a subset, which is shuffled, in list entries, which are only compared
SUBSET_COST = 16
#: sets at least this similar to their leader (in percent) are kept as differences from it
NEAR = 34
#: rounds in which the sets of a list are compared with one of them, before pairs are
STAR_ROUNDS = 2

_U = np.uint64
_MIX = tb.coefficients(2, 17)


def least_common(n, percent: int):
    """Elements a set of ``n`` shares at least with any set similar to it."""
    return (n * percent + 99) // 100


def beginning(n, percent: int):
    """Length of the beginning that shares an element with that of any similar set."""
    return n - least_common(n, percent) + 1


def _beginning(percent: int) -> Column:
    return F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1


def _reserves(words_each: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in tb.groups(batch.column("text")):
                elements, bounds = shingle_sets(group, words_each)
                n = np.diff(bounds)
                some = n > 0
                sums = np.zeros((2, len(n)), _U)
                if some.any():
                    for s, k in zip(sums, _MIX):
                        s[some] = np.add.reduceat(tb.mix64(elements ^ k), bounds[:-1][some])
                first = beginning(n, percent)
                kept = np.minimum(n, first + 5 + first // 2)
                upto = np.concatenate([[0], np.cumsum(kept)])
                where = np.repeat(bounds[:-1] - upto[:-1], kept) + np.arange(upto[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(group.rows)), pa.array(n), *[pa.array(tb.as_int64(s)) for s in sums],
                     pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(_ordered(elements)[where]))],
                    ["id", "n", "s1", "s2", "reserve"])

    return run


def _ordered(elements: np.ndarray) -> np.ndarray:
    """Element hashes as non-negative longs in the same order."""
    return (elements >> _U(1)).view(np.int64)


def _whole(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in tb.groups(batch.column("text")):
                elements, bounds = shingle_sets(group, words_each)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(group.rows)),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_ordered(elements)))], ["id", "elements"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, words_each: int) -> DataFrame:
    """Full sets of the documents with these ids: ``id``, ``elements`` in hash order."""
    return docs.join(ids, "id", "left_semi").mapInArrow(_whole(words_each), "id long, elements array<long>")


def _classes(docs: DataFrame, words_each: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``id, n, rep`` of every row, and ``id, n, reserve`` of the representatives."""
    key = ["n", "s1", "s2"]
    scan = docs.mapInArrow(_reserves(words_each, percent), "id long, n long, s1 long, s2 long, reserve array<long>")
    seen = stage(scan.drop("reserve"), "set-keys")
    classes = seen.where("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"))
    member = stage(seen.join(classes, key, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), "members")
    # scanned again rather than staged with the reserves of all copies; an id that stands for several texts keeps one
    ids = classes.groupBy(F.col("rep").alias("id")).agg(F.min(F.struct(*key)).alias("k")).select("id", "k.*")
    reps = scan.where("n > 0").join(ids, [*key, "id"], "left_semi").dropDuplicates([*key, "id"])  # dealt alike: one exchange
    return member, stage(reps.select("id", "n", "reserve"), "reserves")


def _beginnings(docs: DataFrame, reps: DataFrame, words_each: int, percent: int, frequent: int) -> DataFrame:
    """``id, n, first``: each representative's beginning, one element longer than ``k = 1`` asks for."""
    entries = reps.select("id", F.explode("reserve").alias("e"))
    last = stage(entries.groupBy("e").count().where(F.col("count") > frequent).select("e"), "frequent")
    hits = entries.join(last, "e").groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("late"))  # part of one set each
    early = F.array_except("reserve", F.coalesce("late", F.array().cast("array<long>")))
    wanted = _beginning(percent) + 1
    told = reps.join(hits, "id", "left").withColumn("early", early)
    enough = (F.size("reserve") == F.col("n")) | (F.size("early") >= wanted)
    ranked = F.concat("early", F.coalesce("late", F.array().cast("array<long>")))
    told = stage(told.select("id", "n", F.when(enough, F.slice(ranked, F.lit(1), wanted.cast("int"))).alias("first")), "beginnings")
    short = told.where("first is null").select("id", "n")
    full = (_sets_of(docs, short.select("id"), words_each).select("id", F.explode("elements").alias("e"))
            .join(last.withColumn("late", F.lit(True)), "e", "left")
            .groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("late").isNotNull().alias("late"), "e"))).alias("all")))
    again = full.join(short, "id").select("id", "n", F.slice(F.col("all.e"), F.lit(1), wanted.cast("int")).alias("first"))
    return told.where("first is not null").unionByName(again)


def boundary(costs: list[tuple[int, int, int]]) -> int:
    """The set size up to which emitting subsets is cheapest, from (largest size, subsets, list entries) a class."""
    costs = sorted(costs)
    best, least, so_far = 0, sum(c[2] for c in costs), 0
    rest = least
    for size, subsets, entries in costs:
        so_far, rest = so_far + subsets, rest - entries
        if so_far + rest < least:
            best, least = size, so_far + rest
    return best


def _lists(firsts: DataFrame, percent: int, cut: int | None) -> DataFrame:
    """``bucket, id, n, cap`` of all lists and subsets where a pair can meet, with the ``size`` of each. ``cap`` is the
    most a set can share with another one if this is the first they share."""
    rows = firsts.select("id", "n", F.posexplode("first").alias("r", "e"))
    shared = rows.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = stage(rows.join(shared, "e"), "shared")
    inside = F.col("r") < _beginning(percent)
    if cut is None:
        per_set = rows.groupBy("id", "n").agg(F.count(F.lit(1)).alias("m"), F.sum(F.when(inside, F.col("df")).otherwise(0)).alias("entries"))
        per_class = per_set.groupBy(F.floor(F.log2("n") * CLASSES)).agg(
            F.max("n"), F.sum(F.expr(f"m * (m - 1) div 2 * {SUBSET_COST}")), F.sum("entries"))
        cut = boundary([tuple(r)[1:] for r in per_class.collect()])  # CLASSES rows for each doubling of sizes
    subsets = """flatten(transform(es, (x, i) -> transform(slice(es, i + 2, size(es)),
                 y -> struct(xxhash64(x.e, y.e) AS bucket, n + 1 - y.r AS cap))))"""
    small = (rows.where(F.col("n") <= cut).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("r", "e"))).alias("es"))
             .select("id", "n", F.inline(F.expr(subsets))))
    partner = math.ceil((cut + 1) * percent / 100)
    listed = rows.where(inside & (F.col("n") >= partner)).select("id", "n", F.col("e").alias("bucket"), (F.col("n") - F.col("r")).alias("cap"))
    entries = small.unionByName(listed)
    # the smaller of two similar sets must have room for what it shares with one as large as itself
    leads = F.max((F.col("cap") * (100 + percent) >= F.col("n") * (2 * percent)).cast("int"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), leads.alias("leads")).where("size > 1 and leads = 1")
    return stage(entries.join(sizes.drop("leads"), "bucket"), "lists")


def _sizes_fit(percent: int, a: str = "n1", b: str = "n2") -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _may_be_similar(percent: int) -> tuple[Column, Column]:
    """Where the knowledge of two reserves ends (column ``limit``), and whether they leave a similarity possible: up to
    the limit all elements of both sets are known, beyond it they share at most what one of them has left."""
    limit = F.least(*[F.when(F.size(f"reserve{k}") == F.col(f"n{k}"), F.lit((1 << 63) - 1)).otherwise(F.element_at(f"reserve{k}", -1)) for k in (1, 2)])
    common = F.size(F.array_intersect("reserve1", "reserve2"))
    left = [F.col(f"n{k}") - F.size(F.expr(f"filter(reserve{k}, x -> x <= limit)")) for k in (1, 2)]
    bound = common + F.least(*left)
    return limit, bound * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their reserves do not rule out."""
    ends = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    known = stage(reps.join(ends, "id", "left_semi"), "end-reserves")
    both = pairs
    for k, name in ((1, "a"), (2, "b")):
        both = both.join(known.select(F.col("id").alias(name), F.col("n").alias(f"n{k}"), F.col("reserve").alias(f"reserve{k}")), name)
    limit, similar = _may_be_similar(percent)
    return both.withColumn("limit", limit).where(similar).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, with ``common`` and the sizes ``n_a`` and ``n_b``."""
    ends = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    sets = stage(_sets_of(docs, ends, words_each).dropDuplicates(["id"]), "sets")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b"))
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"),
                       F.size("x").cast("long").alias("n_a"), F.size("y").cast("long").alias("n_b"))
    return both.where((F.col("common") > 0) & (F.col("common") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))))


def _led(lists: DataFrame, percent: int) -> DataFrame:
    """Each set with the leader it shares most lists with, among leaders of a fitting size: ``a, b``."""
    weight = lists.groupBy("id").agg(F.sum("size").alias("weight"))
    leader = (lists.join(weight, "id").groupBy("bucket")
              .agg(F.max(F.struct("weight", (-F.col("id")).alias("m"), "n")).alias("top"))
              .select("bucket", (-F.col("top.m")).alias("b"), F.col("top.n").alias("n2")))
    met = (lists.join(leader, "bucket").where("id <> b").where(_sizes_fit(percent, "n", "n2"))
           .groupBy("id", "b").agg(F.count(F.lit(1)).alias("times")))
    return (met.groupBy("id").agg(F.max(F.struct("times", (-F.col("b")).alias("m"))).alias("top"))
            .select(F.col("id").alias("a"), (-F.col("top.m")).alias("b")))


def _compared(docs: DataFrame, led: DataFrame, words_each: int) -> DataFrame:
    """Each set and its leader on full sets: ``a, b, n_a, n_b, common`` and the difference ``d`` of the two where they are near."""
    ends = stage(led.select(F.col("a").alias("id")).union(led.select("b")).distinct(), "ends")
    sets = stage(_sets_of(docs, ends, words_each).dropDuplicates(["id"]), "sets")
    both = (led.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b"))
    d = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    n_a, n_b = F.size("x").cast("long"), F.size("y").cast("long")
    told = both.select("a", "b", n_a.alias("n_a"), n_b.alias("n_b"), d.alias("d"))
    told = told.withColumn("common", F.expr("(n_a + n_b - size(d)) div 2"))
    return told.withColumn("d", F.when(_similar("common", "n_a", "n_b", NEAR), F.col("d")))


def _similar(common: str, a: str, b: str, percent: int) -> Column:
    return (F.col(common) > 0) & (F.col(common) * 100 >= percent * (F.col(a) + F.col(b) - F.col(common)))


def _differences(near: DataFrame, percent: int) -> DataFrame:
    """Lists of the sets near one leader by the elements of their differences: ``leader, e, id, n, d``. ``near``: id, n, leader, d."""
    # a similar set shares at least this much of the difference, so the beginnings of two differences meet; rare elements come first
    least = F.greatest(F.lit(1), F.size("d") - F.floor(F.col("n") * ((100 - percent) / percent) + F.lit(1e-9)).cast("int"))
    every = near.select("leader", "id", F.explode("d").alias("e"))
    counts = every.groupBy("leader", "e").agg(F.count(F.lit(1)).alias("c"))
    ranked = every.join(counts, ["leader", "e"]).groupBy("leader", "id").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("ranked"))
    entries = ranked.join(near.drop("leader"), "id")
    return (entries.withColumn("first", F.explode(F.slice("ranked", F.lit(1), F.size("d") - least + 1))).where("first.c > 1")
            .select("leader", F.col("first.e").alias("e"), "id", "n", "d"))


def _link(percent: int) -> Column:
    """Whether two sets near one leader (suffixes 1 and 2) are similar, exactly."""
    apart = F.size("d1") + F.size("d2") - 2 * F.size(F.array_intersect("d1", "d2"))
    common = (F.col("n1") + F.col("n2") - apart) / 2
    return (F.col("root1") != F.col("root2")) & _sizes_fit(percent) & (common * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent)


def _sides(entries: DataFrame, *extra: str) -> list[DataFrame]:
    return [entries.select("leader", "e", *extra, *[F.col(c).alias(c + k) for c in ("id", "n", "root", "d")]) for k in "12"]


def _of_one_leader(near: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of sets near the same leader, ``links`` being those known.

    In each list all sets are first compared with one of them, then with one outside the list's main component, and so
    on for ``STAR_ROUNDS`` rounds, with components anew after each; only then are the members of what are
    still different components compared. So a group of copies yields about a link a member, not one a pair.
    """
    lists = stage(_differences(near, percent), "differences")
    found = links
    for k in range(STAR_ROUNDS + 1):
        roots = components(found).withColumnsRenamed({"node": "id"})
        entries = lists.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        main = (entries.groupBy("leader", "e", "root").agg(F.count(F.lit(1)).alias("size"))
                .groupBy("leader", "e").agg(F.max(F.struct("size", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
                .select("leader", "e", F.col("top.root").alias("main")))
        lists = stage(entries.join(main, ["leader", "e"]), "differences")  # lists of one component are done
        left, right = _sides(lists, "main")
        if k == STAR_ROUNDS:
            both = left.where("root1 <> main").join(right.drop("main"), ["leader", "e"])
            pairs = both.where(((F.col("root2") == F.col("main")) | (F.col("id1") < F.col("id2"))) & _link(percent))
        else:
            first = left.where("root1 <> main") if k else left
            closest = F.min_by(F.struct("id1", "n1", "root1", "d1"), F.struct(F.size("d1"), "id1")).alias("h")
            centre = first.groupBy("leader", "e").agg(closest).select("leader", "e", "h.*")
            pairs = right.join(centre, ["leader", "e"]).where(_link(percent))
        found = stage(found.union(pairs.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()), "links")
        lists = lists.drop("main", "root")
    return found


def _met(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different ``root`` and different ``leader`` that meet in a list with room for enough common elements."""
    several = (lists.groupBy("bucket").agg(F.min("leader").alias("l1"), F.max("leader").alias("l2"), F.min("root").alias("r1"), F.max("root").alias("r2"))
               .where("l1 < l2 and r1 < r2").select("bucket"))
    lists = stage(lists.join(several, "bucket"), "mixed")
    # sets of a list's main leader meet the others only
    main = (lists.groupBy("bucket", "leader").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("bucket").agg(F.max(F.struct("size", "leader")).alias("top")).select("bucket", F.col("top.leader").alias("main")))
    left, right = (lists.select("bucket", *[F.col(c).alias(c + k) for c in ("id", "n", "cap", "root", "leader")]) for k in "12")
    left = left.join(main, "bucket").where("leader1 <> main")
    return (left.join(right, "bucket")
            .where(((F.col("leader2") == F.col("main")) | (F.col("id1") < F.col("id2"))) & (F.col("root1") != F.col("root2"))
                   & (F.col("leader1") != F.col("leader2")) & _sizes_fit(percent)
                   & (F.least("cap1", "cap2") * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent))
            .select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct())


def _candidates(df: DataFrame, id_col: str, text_col: str, words_each: int, percent: int, frequent: int, cut: int | None):
    if not 51 <= percent <= 100:
        raise ValueError("percent must lie between 51 and 100")  # below, similar sets need not share two elements
    prepare(df.sparkSession)
    docs = pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    member, reps = _classes(docs, words_each, percent)
    return docs, member, reps, _lists(_beginnings(docs, reps, words_each, percent, frequent), percent, cut)


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, percent: int = 85,
                  frequent: int = FREQUENT, cut: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All links between class representatives (``a < b``, ``common``, ``n_a``, ``n_b``), and the membership (``id``, ``n``, ``rep``)."""
    docs, member, reps, lists = _candidates(df, id_col, text_col, words_each, percent, frequent, cut)
    pairs = stage(_met(lists.withColumns({"root": F.col("id"), "leader": F.col("id")}), percent), "pairs")
    return _verified(docs, stage(_plausible(pairs, reps, percent), "pairs"), words_each, percent), member


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, percent: int = 85,
                    frequent: int = FREQUENT, cut: int | None = None) -> DataFrame:
    """Per row: the id, ``n_shingles`` (set size) and ``component_id`` (smallest id reachable over links, itself included;
    null for a null id). ``cut`` overrides the boundary found by cost (0: lists only)."""
    docs, member, reps, lists = _candidates(df, id_col, text_col, words_each, percent, frequent, cut)
    led = stage(_plausible(stage(_led(lists, percent), "led"), reps, NEAR), "led")
    compared = stage(_compared(docs, led, words_each), "compared")
    links = compared.where(_similar("common", "n_a", "n_b", percent)).select("a", "b")
    one_id = (member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
              .where("a < b").select("a", "b"))
    links = stage(links.union(one_id), "links")
    named = components(links).withColumnsRenamed({"node": "id"})
    near = compared.where("d is not null").select(F.col("a").alias("id"), F.col("n_a").alias("n"), F.col("b").alias("leader"), "d")
    near = stage(near, "near")
    known = lists.select("bucket", "id", "n", "cap").join(near.select("id", "leader"), "id", "left").join(named, "id", "left")
    known = known.withColumns({"leader": F.coalesce("leader", "id"), "root": F.coalesce("root", "id")})
    pairs = stage(_met(stage(known, "named"), percent), "pairs")
    others = _verified(docs, stage(_plausible(pairs, reps, percent), "pairs"), words_each, percent).select("a", "b")
    roots = components(_of_one_leader(near, stage(links.union(others), "links"), percent)).withColumnsRenamed({"node": "rep"})
    return (member.join(roots, "rep", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component_id")))


def oracle(words_each: int = 4, percent: int = 85) -> str:
    """DuckDB SQL: all pairs that share a shingle are counted, links closed transitively."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE w AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (
      SELECT DISTINCT doc_id, array_to_string(w[i:i + {words_each - 1}], ' ') AS e
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words_each - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS MATERIALIZED (
      SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (e) WHERE x.doc_id <> y.doc_id GROUP BY a, b)
      JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.root)
    SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id
    FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id"""
