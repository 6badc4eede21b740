import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stintlab.llm import prefix_hashes as ph

from .helpers import frame, rows


@settings(max_examples=60, deadline=None)
@given(st.text("abé😀", max_size=60), st.text("abé😀", max_size=60), st.integers(0, 60), st.integers(0, 60), st.integers(0, 30))
def test_span_equality_and_extension(a, b, i, j, n):
    x, y = ph.PrefixHashes(a), ph.PrefixHashes(b)
    if i + n <= len(a) and j + n <= len(b):
        assert x.equal(i, y, j, n) == (a[i:i + n] == b[j:j + n])
    if i <= len(a) and j <= len(b):
        longest = 0
        while i + longest < len(a) and j + longest < len(b) and a[i + longest] == b[j + longest]:
            longest += 1
        assert x.common_extension(i, y, j) == longest


def test_span_hash_is_the_polynomial():
    text = "prefix é😀 hashes"
    hashes = ph.PrefixHashes(text)
    for which, p in enumerate(ph.PRIMES):
        for i, n in ((0, 5), (3, 9), (7, 0)):
            assert hashes.span(i, n)[which] == sum((ord(c) + 1) * pow(ph.BASES[which], k, p) for k, c in enumerate(text[i:i + n])) % p
    with pytest.raises(IndexError):
        hashes.span(10, 10)


def brute(data):
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for k, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        f, e, n = ph.fingerprints([text, edited, after])
        out.append((str(r[0]), len(text), hashlib.sha256(edited.encode()).hexdigest(), f, e, ph.likeness(f, e), ph.likeness(f, n)))
    return sorted(out)


def test_edited_texts_and_likeness(spark):
    for data in (rows(), rows() + [rows()[4], (None, "no id", None, None, None), (None, None, None, None, None)], rows()[:1]):
        out = ph.edited_fingerprints(frame(spark, data).repartition(3))
        assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == brute(data)
    assert ph.edited_fingerprints(frame(spark, [])).count() == 0


def test_groups_do_not_change_fingerprints(spark, monkeypatch):
    texts = [r[1] or "" for r in rows()]
    whole = ph.fingerprints(texts)
    monkeypatch.setattr(ph, "GROUP_CHARS", 100)
    assert ph.fingerprints(texts) == whole
    assert len({(t, f) for t, f in zip(texts, whole)}) == len(set(texts)) == len(set(whole))
    assert ph.likeness(*ph.fingerprints(["", ""])) == 1.0 and ph.likeness(*ph.fingerprints(["", "x"])) == 0.0
    got = {r["doc_id"]: r["fingerprint"] for r in ph.fingerprint_texts(frame(spark)).collect()}
    assert got == dict(zip([r[0] for r in rows()], whole))


def test_common_extension_column(spark):
    df = spark.createDataFrame([("hello world", "yellow world", 1, 1), (None, "a", 0, 0)], "a string, b string, i long, j long")
    out = ph.with_common_extension(df, F.col("a"), F.col("b"), F.col("i"), F.col("j"))
    assert [r["extension"] for r in out.collect()] == [4, None]
