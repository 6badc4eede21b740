import math

from pyspark.sql import functions as F

from stintlab.llm import license_scan as ls

from .helpers import frame

TEXT = "und der die das auch eine zeile mit worten " * 6


def brute(data, threshold=ls.THRESHOLD):
    split = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").translate(str.maketrans(ls._UPPER, ls._LOWER))).split()]
    vocabulary = {w for t in ls.TEMPLATES.values() for w in split(t)}
    weight = {w: math.log((1 + len(data)) / (1 + sum(w in set(split(t)) for _, t, *_ in data))) + 1 for w in vocabulary}
    other = math.log(1 + len(data)) + 1
    vector = lambda ws: {w: ws.count(w) * weight.get(w, other) for w in set(ws)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for i, text, *_ in data:
        for line in (text or "").split("\n"):
            v = vector(split(line))
            for name in sorted(ls.TEMPLATES):
                t = vector(split(ls.TEMPLATES[name]))
                score = round(sum(x * t[w] for w, x in v.items() if w in t) / (norm(v) * norm(t)), 6) if v else 0.0
                if score >= threshold and (-score, name) < (-own[i][1], own[i][0]) if i in own else score >= threshold:
                    own[i] = (name, score)
    files = {}
    for i, text, _, path, _ in sorted(data, key=lambda r: r[0]):
        if i in own and len(split(text)) <= ls.FILE_WORDS:
            files.setdefault(path or "", own[i][0])
    out = []
    for i, text, _, path, _ in data:
        path = path or ""
        levels = path.split("/")
        above = ["/".join(levels[:k]) for k in range(len(levels), -1, -1)]
        place = next((d for d in above if d in files), None)
        license, score = own.get(i, (None, None))
        out.append((i, license, score, path, place, files.get(place), license or files.get(place)))
    return sorted(out, key=str)


def data():
    t = list(ls.TEMPLATES.values())
    return [(1, TEXT, None, "a/b/c", 0), (2, t[8], None, "a/b", 0), (3, TEXT + "\n" + t[0] + ".\n" + TEXT, None, "a/b/c", 0),
            (4, "kurz\n" + t[6] + ".", None, "a", 0), (5, TEXT, None, "a/x/y", 0), (6, TEXT, None, "z", 0), (7, None, None, None, 0),
            (8, "", None, "a/bc", 0), (9, t[2].upper() + "!", None, "q/r", 0), (10, t[3], None, "q/r", 0), (11, TEXT, None, "q/r/s/t", 0),
            (12, "the work is under the version of the license", None, "z", 0), (13, "MIT", None, "z/mit", 0),
            (14, "public license, version 2.0 terms", None, "m", 0), (15, t[8] + " " + TEXT, None, "n", 0), (16, t[8] + "\n" + t[0], None, "o", 0)]


def run(spark, rows):
    df = frame(spark, rows).withColumn("license", F.lit("clash")).withColumn("directory", F.lit(1))
    return sorted((tuple(r) for r in ls.scan(df, F.col("source")).collect()), key=str)


def test_equals_brute_force(spark):
    assert run(spark, data()) == brute(data())
    found = {r[0]: r for r in run(spark, data())}
    assert found[3][1] == "Apache-2.0" and found[1][5] == "MIT" and found[5][5] == "GPL-3.0" and found[6][6] is None


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = ls.scan(docs, F.concat_ws("/", "source", "lang")).where("license is not null").select("doc_id")
    notice = "(apache license, version 2.0|mit license|general public license|licensed under cc|all rights reserved)"
    told = docs.where(F.lower("text").rlike(notice)).select("doc_id")
    assert told.count() > 0 and told.join(out, "doc_id", "left_anti").count() == 0
    assert docs.join(out, "doc_id").join(told, "doc_id", "left_anti").count() == 0


def test_repeated_rows_and_empty_tables(spark):
    assert run(spark, data() + data()[1:3])[0] is not None
    assert len(run(spark, data() + data()[1:3])) == len(data()) + 2
    assert run(spark, []) == []


def test_telling_words_miss_no_line():
    weight = {w: 1.0 + len(w) for t in ls.TEMPLATES.values() for w in ls._words_of(t)}
    telling = set(ls._telling(ls.TEMPLATES, weight, 0.75))
    for text in ls.TEMPLATES.values():
        rest = [w for w in ls._words_of(text) if w not in telling]
        assert sum(weight[w] ** 2 for w in rest) < 0.75**2 * sum(weight[w] ** 2 for w in ls._words_of(text))


CASES = {
    "GPL-3.0": "# {f}\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as "
               "published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os\n" + TEXT,
    "Apache-2.0": TEXT + "\n\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                  "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n",
    "MIT": TEXT + "\nThis software is released under the MIT License, see the file LICENSE for details.\n" + TEXT,
    "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n"
               "// file, You can obtain one at http://mozilla.org/MPL/2.0/.\nint x;\n" + TEXT,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\n"
                    "are met:\n\n" + TEXT,
}


def test_headers_titles_and_whole_texts(spark):
    rows = [(k, text, None, f"d{k}", 0) for k, text in enumerate(CASES.values())]
    whole = [(20 + k, ls.TEXTS[name][-1] + "\n" + TEXT, None, f"w{k}", 0) for k, name in enumerate(["GPL-2.0", "GPL-3.0", "MIT", "LGPL-3.0"])]
    title = [(30, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", None, "t", 0)]
    rest = [(40 + k, TEXT + f" the work of it is for you and the others {k}", None, "r", 0) for k in range(20)]
    found = {r[0]: r[1] for r in run(spark, rows + whole + title + rest)}
    assert [found[k] for k in range(len(CASES))] == list(CASES)
    assert [found[20 + k] for k in range(4)] == ["GPL-2.0", "GPL-3.0", "MIT", "LGPL-3.0"] and found[30] == "GPL-3.0"
    assert not any(found[40 + k] for k in range(20))


def test_long_licence_files_give_their_directory_a_licence(spark):
    mit = "Copyright (c) 2020 The Authors\n\n" + ls.TEXTS["MIT"][-1]
    apache = ls.TEXTS["Apache-2.0"][-1]
    assert len(mit.split()) > 3 * ls.FILE_WORDS and len(apache.split()) > 1000
    rows = [(1, mit, None, "p", 0), (2, TEXT, None, "p/q", 0), (3, apache, None, "p/r", 0), (4, TEXT, None, "p/r/s", 0),
            (5, CASES["GPL-3.0"] + TEXT * 3, None, "h", 0), (6, TEXT, None, "h/i", 0)]
    found = {r[0]: r for r in run(spark, rows)}
    assert found[2][4:] == ("p", "MIT", "MIT") and found[4][4:] == ("p/r", "Apache-2.0", "Apache-2.0")
    # a source file with a header is no licence file
    assert found[5][1] == "GPL-3.0" and found[6][6] is None


def vectors_of(texts):
    out = []
    for name, text in texts:
        counts = {w: ls._words_of(text).count(w) for w in set(ls._words_of(text))}
        norm = math.sqrt(sum(n * n for n in counts.values()))
        out.append((name, {w: n / norm for w, n in counts.items()}))
    return out


def test_a_part_is_dropped_if_it_has_too_few_words_for_every_template(spark):
    whole = [(name, texts[-1]) for name, texts in sorted(ls.TEXTS.items())]
    vectors = vectors_of(whole)
    cosine = lambda ws, v: sum(ws.count(w) * v.get(w, 0.0) for w in set(ws)) / math.sqrt(sum(ws.count(w) ** 2 for w in set(ws)))
    few = [sorted(v, key=v.get, reverse=True)[:2] for _, v in vectors]  # two words, whatever their weight in one licence, are no other licence
    few = [ws for ws in few if max(sum(v.get(w, 0.0) ** 2 for w in ws) for _, v in vectors) < 0.5]
    parts = [ls._words_of(text)[:n] for _, text in whole for n in (5, 40, 64, 65, 100, 200, 400, 10**6)] + few + [[]]
    rows = spark.createDataFrame([(k, ws) for k, ws in enumerate(parts)], "k int, ws array<string>")
    kept = {r["k"] for r in rows.where(ls._can_reach(F.col("ws"), vectors, 0.75)).collect()}
    reaching = {k for k, ws in enumerate(parts) if ws and max(cosine(ws, v) for _, v in vectors) >= 0.75}
    assert len(reaching) > len(whole) and reaching <= kept
    assert few and not any(k in kept for k in range(len(parts) - len(few) - 1, len(parts)))


def test_short_files_are_told_by_their_first_words(spark):
    texts = ["", " ", "a", "a b c", " a b c ", "A,b;C.", "a b c d", " a b c d", "a b c d ", "K İ a b c", "a b c d e f", "äaß9 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    told = rows.select((F.size(ls.words(F.col("t"))) <= 3).alias("slow"), ls._is_short(F.col("t"), 3).alias("short")).collect()
    assert [r["short"] for r in told] == [r["slow"] for r in told] and {r["slow"] for r in told} == {True, False}


def test_letter_case_and_rows_of_one_id_with_other_texts(spark):
    t = ls.TEMPLATES["MIT"]
    rows = [(1, t.upper(), None, "a", 0), (1, t, None, "a", 0), (2, TEXT.upper() + "\n# " + t.swapcase() + "\n" + TEXT, None, "b", 0), (3, TEXT, None, "c", 0)]
    assert run(spark, rows) == brute(rows)
