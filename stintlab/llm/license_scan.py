"""Licence scan: TF-IDF cosine of files, headers and notices to templates, then inheritance along directories.

*Statistics.* Inverse document frequencies ``ln((1 + N) / (1 + df)) + 1`` of all words are counted over all files, as one
distributed table. *Parts* of a file are its lines, its paragraphs, its header (the comment lines it begins with) and
its whole text; each is a vector of word counts times weights. *Templates* are the notices of ``TEMPLATES`` and the
titles, headers and whole licence texts of ``license_texts``. The cosine with a template is a sparse join of the part's
words with the template's. A part is looked at only if it can reach the threshold: by Cauchy-Schwarz it must hold words
with ``threshold ** 2`` of a template's squared weight, which is tested with the *telling* words and then with the
``TOP`` heaviest words of each template, the others taken as found, so no part is missed. Then a bound of the score is
added up over its words: the exact dot product with each template, and a norm from below, in which words that are neither
in a template nor among the ``FREQUENT`` most frequent ones weigh as much as the rarest of these. Only parts that may
still reach the threshold are joined with the frequencies of all words. A file's own licence is its best part's.

*Inheritance.* A file is a licence file of its directory if its whole text reaches the threshold, however long it is, and
gives the directory the licence of its whole text; so is a note with a licence (``file_words`` words at most). A file
without a licence of its own takes that of the nearest directory at or above its own that has one; a
directory's licence is that of its licence file with the smallest id. Directories are joined with their ancestors,
files only with their own directory.

Everything is DataFrame expressions; only template words and their counts reach the driver. Defined results:
null and empty texts have no licence of their own, nor have rows with a null id; a null path is the root; ties between templates go to the
first name, between parts to the better score; rows that share an id share a result (their best part); repeated rows are
returned as often as they come; an empty table gives an empty result; extra columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stage
from .license_texts import TEXTS

# Short names and usual notice lines of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use permitted under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "Proprietary": "Copyright, all rights reserved",
}
THRESHOLD = 0.75
FILE_WORDS = 40
#: heaviest words of a template that a part is tested for before its vector is built
TOP = 12
#: parts of up to so many words are told apart by each number of words, longer ones by its power of two
SHORT_PART = 64
#: most frequent words of the files that are sent to the tasks with their weights
FREQUENT = 4096
LINE, PARAGRAPH, HEADER, WHOLE = 0, 1, 2, 3
#: a line of a comment, or blank
COMMENT = r"^\s*($|#|//|/\*|\*|--|;|%|<!--)"
NOT_WORD = "[^a-z0-9]+"
#: flag of a pattern: ASCII letters match in either case
ANY_CASE = "(?i)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_of(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]


def _lowered(text: Column) -> Column:
    """With ASCII letters in lower case, others as they are."""
    return F.translate(text, _UPPER, _LOWER)


def _split(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def words(text: Column) -> Column:
    """Words of ASCII letters and digits, in lower case."""
    return _split(_lowered(text))


def _is_short(text: Column, most: int) -> Column:
    """Whether a text has ``most`` words or fewer. It is split no further than that takes: of ``most + 3`` pieces the first and the
    last may be empty, the rest are words."""
    return F.size(F.array_remove(F.split(text, ANY_CASE + NOT_WORD, most + 3), "")) <= most


def _frequencies(files: DataFrame) -> DataFrame:
    """In how many files each word occurs: ``w`` and ``df``."""
    return stage(files.select(F.explode(F.array_distinct(words(F.col("text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")), "frequencies")


def _weights(frequencies: DataFrame, n: int, vocabulary: set[str]) -> dict[str, float]:
    """Weight of each template word."""
    known = frequencies.sparkSession.createDataFrame([(w,) for w in sorted(vocabulary)], "w string")
    df = {r["w"]: r["df"] for r in frequencies.join(F.broadcast(known), "w", "left_semi").collect()}  # a row for each template word at most
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}


def _telling(templates: dict[str, str], weight: dict[str, float], threshold: float) -> list[str]:
    """Words of which every line that reaches the threshold has at least one."""
    out: set[str] = set()
    for text in templates.values():
        squares = sorted(((n * weight[w]) ** 2, w) for w, n in Counter(_words_of(text)).items())
        norm, rest = sum(s for s, _ in squares), 0.0
        for square, w in squares:
            rest += square
            if rest >= (threshold * 0.999) ** 2 * norm:
                out.add(w)
    return sorted(out)


def _can_reach(ws: Column, vectors: list[tuple[str, dict[str, float]]], threshold: float) -> Column:
    """Whether the words could reach the threshold with a template, if of its words but the ``TOP`` heaviest there were the heaviest,
    as many as the part has words."""
    shares: dict[str, list[float]] = {}
    rest: list[list[float]] = []
    for k, (_, vector) in enumerate(vectors):
        squares = sorted(((y, w) for w, y in vector.items()), reverse=True)
        for y, w in squares[:TOP]:
            shares.setdefault(w, [0.0] * len(vectors))[k] = y * y
        rest.append([y * y for y, _ in squares[TOP:]])
    # of parts of no more than so many words: the most that words but the heaviest can hold
    limits = [*range(SHORT_PART + 1), *[SHORT_PART << j for j in range(1, max(map(len, rest)).bit_length())]]
    most = [[sum(own[:m]) for own in rest] for m in limits]
    n = F.size(ws)
    place = F.when(n <= SHORT_PART, n).otherwise(F.least(SHORT_PART + F.ceil(F.log2(n / SHORT_PART)), F.lit(len(limits) - 1))) + 1
    # as JSON: thousands of literals take the driver longer than the scan
    table = F.from_json(F.lit(json.dumps(shares)), "map<string,array<double>>")
    found = F.array_intersect(ws, F.split(F.lit(" ".join(sorted(shares))), " "))
    start = F.element_at(F.from_json(F.lit(json.dumps(most)), "array<array<double>>"), place.cast("int"))
    reach = F.aggregate(found, start, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda x, y: x + y))
    return F.exists(reach, lambda x: x >= (threshold * 0.999) ** 2)


def _parts(files: DataFrame, telling: list[str]) -> DataFrame:
    """Lines, paragraphs, header and whole text of files with a telling word, in lower case: ``id``, ``tag``, ``kind``, ``at``, ``part``."""
    any_word = "(?<![a-z0-9])(" + "|".join(telling) + ")(?![a-z0-9])"
    lines, part = F.split("text", "\n"), lambda kind, at, text: F.struct(F.lit(kind).alias("kind"), at.cast("int").alias("at"), text.alias("part"))
    # 0 if all lines are comments: then the header is the whole text
    code = F.array_position(F.transform(lines, lambda line: ~line.rlike(COMMENT)), F.lit(True))
    header = F.array_join(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(0)).cast("int")), "\n")
    parts = F.concat(F.transform(lines, lambda line, k: part(LINE, k, line)),
                     F.transform(F.split("text", r"\n[ \t\r#*/;%-]*\n"), lambda text, k: part(PARAGRAPH, k, text)),
                     F.array(part(HEADER, F.lit(0), header), part(WHOLE, F.lit(0), F.col("text"))))
    # texts are lowered once, after the filter; comment marks and blank lines are the same in either case
    told = files.where(F.col("text").rlike(ANY_CASE + any_word)).select("id", F.xxhash64("text").alias("tag"), _lowered(F.col("text")).alias("text"))
    return told.select("id", "tag", F.explode(parts).alias("p")).select("id", "tag", "p.*").where(F.col("part").rlike(any_word))


def _survivors(parts: DataFrame, key: list[str], frequencies: DataFrame, n: int, weight: dict[str, float],
               vectors: list[tuple[str, dict[str, float]]], threshold: float) -> DataFrame:
    """Keys of the parts whose bound reaches the threshold. As ``tf ** 2 >= tf``, a part's squared norm is at least the sum of
    the squared weights over all its words, and dot products are sums over them too: one row a word, one result a part."""
    top = frequencies.orderBy(F.desc("df"), "w").limit(FREQUENT).collect()
    known = {r["w"]: math.log((1 + n) / (1 + r["df"])) + 1 for r in top}
    least = math.log((1 + n) / (1 + top[-1]["df"])) + 1 if top else 1.0
    known |= weight
    rows = [(w, g * g, [g * vector.get(w, 0.0) for _, vector in vectors]) for w, g in known.items()]
    table = parts.sparkSession.createDataFrame(rows, "w string, square double, shares array<double>")
    told = parts.select(*key, F.explode("ws").alias("w")).join(F.broadcast(table), "w", "left")  # FREQUENT and the templates' words
    sums = told.groupBy(*key).agg(F.sum(F.coalesce("square", F.lit(least * least))).alias("square"),
                                  *[F.sum(F.get("shares", F.lit(k))).alias(f"dot{k}") for k in range(len(vectors))])
    reach = F.greatest(*[F.coalesce(f"dot{k}", F.lit(0.0)) for k in range(len(vectors))])
    return stage(sums.where(reach >= threshold * 0.999 * F.sqrt("square")).select(*key), "survivors")


def own_licenses(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
                 texts: dict[str, list[str]] = TEXTS) -> DataFrame:
    """The best template of each file with a part at or over the threshold: ``id``, ``license``, ``score``; and
    ``whole``, the best one of its whole text if that is at or over the threshold. ``files`` has ``id`` and ``text``."""
    spark = files.sparkSession
    named = [(name, text) for name in sorted({*templates, *texts}) for text in [*filter(None, [templates.get(name)]), *texts.get(name, [])]]
    counted = [(name, Counter(_words_of(text))) for name, text in named]
    frequencies, n = _frequencies(files), files.count()
    weight = _weights(frequencies, n, {w for _, c in counted for w in c})
    vectors = []
    for name, c in counted:
        norm = math.sqrt(sum((k * weight[w]) ** 2 for w, k in c.items()))
        vectors.append((name, {w: k * weight[w] / norm for w, k in c.items()}))
    telling = _telling({str(k): text for k, (_, text) in enumerate(named)}, weight, threshold)
    entries = [(name, k, w, y) for k, (name, vector) in enumerate(vectors) for w, y in sorted(vector.items())]
    table = F.broadcast(spark.createDataFrame(entries, "license string, rank int, w string, y double"))  # the templates' words
    key = ["id", "tag", "kind", "at"]
    # exploded from an array of one: a filter on a plain projection would split the part again wherever it names its words
    parts = _parts(files, telling).select(*key, F.explode(F.array(_split(F.col("part")))).alias("ws")).where(_can_reach(F.col("ws"), vectors, threshold))
    kept = _survivors(parts, key, frequencies, n, weight, vectors, threshold)
    few = files.join(kept.select("id").distinct(), "id", "left_semi")
    parts = _parts(few, telling).select(*key, _split(F.col("part")).alias("ws")).join(kept, key, "left_semi")
    counts = parts.select(*key, F.explode("ws").alias("w")).groupBy(*key, "w").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    terms = counts.join(frequencies, "w").select(*key, "w", (F.col("n") * idf).alias("x"))
    # one row a part: its norm, and its entries
    shared = F.collect_list(F.struct("w", "x")).alias("shared")
    part = terms.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), shared)
    dots = (part.select(*key, "norm", F.explode("shared").alias("s")).select(*key, "norm", "s.w", "s.x").join(table, "w")
            .groupBy(*key, "norm", "license", "rank").agg((F.sum(F.col("x") * F.col("y")) / F.col("norm")).alias("score")))
    rounded = dots.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("license", "score"), F.struct("score", -F.col("rank")))
    whole = F.max_by("license", F.when(F.col("kind") == WHOLE, F.struct("score", -F.col("rank"))))
    return rounded.groupBy("id").agg(best.alias("b"), whole.alias("whole")).select("id", "b.license", "b.score", "whole")


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES,
         threshold: float = THRESHOLD, file_words: int = FILE_WORDS) -> DataFrame:
    """Per row: the id, ``license`` and ``score`` (its own, or null), ``directory``, ``license_dir`` and
    ``inherited`` (of the nearest directory with a licence file, null if none), and ``effective``.

    ``path`` gives a row's directory, its levels divided by slashes.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                     F.coalesce(path, F.lit("")).alias("directory"))
    own = stage(own_licenses(rows.select("id", "text"), templates, threshold), "licenses")
    light = rows.select("id", "directory", _is_short(F.col("text"), file_words).alias("short"))
    named = stage(light.join(own, "id", "left"), "files")
    sources = (named.withColumn("given", F.coalesce("whole", F.when(F.col("short"), F.col("license")))).where("given is not null")
               .groupBy("directory").agg(F.min_by("given", "id").alias("inherited")))
    levels = F.split("directory", "/")
    above = (named.select("directory").distinct()
             .select("directory", F.explode(F.sequence(F.lit(0), F.size(levels))).alias("depth"))
             .withColumn("license_dir", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(levels, 1, F.greatest("depth", F.lit(1))), "/"))))
    nearest = (above.join(sources.withColumnRenamed("directory", "license_dir"), "license_dir")
               .groupBy("directory").agg(F.max_by(F.struct("license_dir", "inherited"), "depth").alias("n"))
               .select("directory", "n.*"))
    return (named.join(nearest, "directory", "left")
            .select(F.col("id").alias(id_col), "license", "score", "directory", "license_dir", "inherited",
                    F.coalesce("license", "inherited").alias("effective")))


def oracle(path_sql: str, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, file_words: int = FILE_WORDS) -> str:
    values = ", ".join(f"('{name}', '{text.lower()}')" for name, text in templates.items())
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH templates(license, notice) AS (VALUES {values}),
parts AS (SELECT license, unnest(list_filter(regexp_split_to_array(notice, '{NOT_WORD}'), lambda x: x <> '')) AS w FROM templates),
pairs AS (SELECT license, w, count(*) AS n FROM parts GROUP BY ALL),
files AS (SELECT doc_id AS id, coalesce(text, '') AS text, coalesce({path_sql}, '') AS directory FROM documents),
told AS (SELECT *, list_filter(regexp_split_to_array({lower}, '{NOT_WORD}'), lambda x: x <> '') AS ws FROM files),
seen AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS w FROM told) WHERE w IN (SELECT w FROM pairs) GROUP BY w),
size AS (SELECT count(*) AS n FROM files),
idf AS (SELECT DISTINCT w, ln((1 + size.n) / (1 + coalesce(df, 0))) + 1 AS g FROM pairs LEFT JOIN seen USING (w), size),
lines AS (SELECT id, unnest(string_split({lower}, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos, row_number() OVER () AS r FROM files),
terms AS (SELECT id, r, pos, w, count(*) AS n FROM (
            SELECT id, r, pos, unnest(list_filter(regexp_split_to_array(line, '{NOT_WORD}'), lambda x: x <> '')) AS w FROM lines) GROUP BY ALL),
valued AS (SELECT id, r, pos, w, t.n * coalesce(g, ln(1 + size.n) + 1) AS x FROM terms t LEFT JOIN idf USING (w), size),
norms AS (SELECT id, r, pos, sqrt(sum(x * x)) AS norm FROM valued GROUP BY ALL),
tnorm AS (SELECT license, sqrt(sum(n * g * n * g)) AS norm FROM pairs JOIN idf USING (w) GROUP BY license),
scores AS (SELECT v.id, p.license, round(sum(x * p.n * g / t.norm) / a.norm, 6) AS score
           FROM valued v JOIN pairs p USING (w) JOIN idf USING (w) JOIN tnorm t ON t.license = p.license
           JOIN norms a ON a.id IS NOT DISTINCT FROM v.id AND a.r = v.r AND a.pos = v.pos GROUP BY v.id, v.r, v.pos, p.license, a.norm),
own AS (SELECT id, license, score FROM scores WHERE score >= {threshold}
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, license) = 1),
named AS (SELECT told.id, directory, len(ws) <= {file_words} AS short, license, score FROM told LEFT JOIN own USING (id)),
sources AS (SELECT directory AS license_dir, arg_min(license, id) AS inherited FROM named WHERE short AND license IS NOT NULL GROUP BY directory),
nearest AS (SELECT d.directory, license_dir, inherited FROM (SELECT DISTINCT directory FROM named) d
            JOIN sources s ON s.license_dir = '' OR d.directory = s.license_dir OR starts_with(d.directory, s.license_dir || '/')
            QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(license_dir) DESC) = 1)
SELECT id AS doc_id, license, score, directory, license_dir, inherited, coalesce(license, inherited) AS effective
FROM named LEFT JOIN nearest USING (directory)
"""
