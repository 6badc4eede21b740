import hashlib

from stintlab.llm import substring_dedup

from .helpers import frame, rows, words


def brute(data, k):
    first, out = {}, {}
    for i, text, *_ in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p:p + k]), i)
    for i, text, *_ in data:
        w, gone = words(text), set()
        for p in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[p:p + k])] < i:
                gone.update(range(p, p + k))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def got(out):
    found = {}
    for r in out.collect():
        found.setdefault(r[0], []).append((r["n_words"], r["n_removed"], r["kept_sha256"]))
    return {i: sorted(v) for i, v in found.items()}


def test_equals_brute_force_for_several_lengths(spark):
    data = rows()
    data += [data[3], (data[5][0], data[0][1], "en", "s", 0), (None, data[0][1], "en", "s", 0)]  # repeated row, shared id, null id
    for k, seed in ((50, 20), (12, 5), (3, 3)):
        assert got(substring_dedup.remove_repeats(frame(spark, data), min_words=k, seed_words=seed)) == brute(data, k)


def test_small_blocks_settle_alike(spark, monkeypatch):
    data = rows()
    parts = []

    def windows(texts, block):
        monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", block)
        import pyarrow as pa
        anchors = list(substring_dedup._anchors(50, 20)(iter([pa.RecordBatch.from_pydict({"id": [r[0] for r in texts], "text": pa.array([r[1] for r in texts], pa.string())})])))
        by = {}
        for b in anchors:
            for a, i in zip(b.column("anchor").to_pylist(), b.column("id").to_pylist()):
                by.setdefault(i, []).append(a)
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in texts]), pa.array([0] * len(texts), pa.int32()), pa.array([r[1] for r in texts], pa.string()),
                                            pa.array([by.get(r[0]) for r in texts], pa.list_(pa.int64()))], ["id", "tag", "text", "anchors"])
        return sum(b.num_rows for b in substring_dedup._windows(50, 20)(iter([batch])))

    parts = [windows(data, 1 << 20), windows(data, 1)]
    assert 0 < parts[0] <= parts[1]


def test_empty_table_and_extra_columns(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    df = frame(spark).withColumnRenamed("lang", "tag").withColumnRenamed("source", "anchors")
    assert got(substring_dedup.remove_repeats(df)) == brute(rows(), 50)
    carried = substring_dedup.remove_repeats(df, carry=["tag", "n_chars"], as_is=True)
    assert carried.columns[:3] == ["doc_id", "tag", "n_chars"]
    whole = {r["doc_id"]: r["kept_text"] for r in carried.where("n_removed = 0").collect()}
    texts = {r[0]: r[1] for r in rows()}
    assert all(texts[i] == t for i, t in whole.items())
