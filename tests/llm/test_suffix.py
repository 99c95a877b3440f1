import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cardpulse.llm import suffix
from hostile import empty, hostile

SF = "/root/testdata/sf0.001"


def expected(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s:s + length] for b in data for s in range(len(b) - length + 1))
    out = Counter()
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()) if len(b) else 0
        out[(i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(suffix.without_repeats(docs)) == expected(rows, 400)


def _shared_passages(rng):
    """Near copies of one text with edits in many places, passages in other surroundings, runs of one letter."""
    base = "".join(rng.choice(list("abcd ")) for _ in range(1500))
    rows = []
    for i in range(40):
        t = list(base)
        for k in rng.choice(len(t), 3, replace=False):
            t[k] = "Z"
        rows.append((i, "".join(t)))
    for i in range(40, 60):
        lo = int(rng.integers(0, 900))
        rows.append((i, f"head {i} " + base[lo:lo + int(rng.integers(350, 600))] + f" tail {i}"))
    rows += [(60, "a" * 900), (61, "ab" * 700), (62, "b" + "a" * 410), (63, base[:400]), (64, base[:399])]
    return rows


@pytest.mark.parametrize("hot_classes", [0, 3, 512])
def test_partial_overlaps(spark, hot_classes):
    rows = _shared_passages(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix.without_repeats(docs, hot_classes=hot_classes)) == expected(rows, 400)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1000)
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh ")) for _ in range(7000))
    rows = [(1, long), (2, long[2500:4200] + "!"), (3, long[900:1400])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix.without_repeats(docs)) == expected(rows, 400)


def test_hostile_rows(spark):
    docs = hostile(spark).where("doc_id is null or doc_id not in (6, 7)")
    assert got(suffix.without_repeats(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()], 400)
    long = suffix.without_repeats(hostile(spark)).where("doc_id in (6, 7)").collect()
    assert [r["n_removed"] == r["n_bytes"] for r in long] == [True, True]
    assert suffix.without_repeats(empty(spark)).count() == 0


def test_stretches_of_many_windows_stay_in_arrays(spark):
    """A class of a hot gram has up to a stretch for every offset; as Python rows a task's classes took over a gigabyte."""
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = [(k, sorted({(int(a), int(a + rng.integers(1, 9))) for a in rng.integers(0, 90, rng.integers(1, 12))})) for k in range(3000)]
    plain = {}
    for k, spans in rows:
        for a, b in spans:
            if k in plain and a <= plain[k][-1][1]:
                plain[k][-1][1] = max(plain[k][-1][1], b)
            else:
                plain.setdefault(k, []).append([a, b])
    df = spark.createDataFrame([(k, a, b) for k, spans in rows for a, b in spans], "k long, j long, b long").withColumnsRenamed({"j": "a"})
    got = suffix._merged(df.withColumn("j", df.k), ["k", "j"])
    assert {r["k"]: [[s["a"], s["b"]] for s in r["spans"]] for r in got.collect()} == plain

    key = np.repeat(np.arange(suffix.MERGED_KEYS), 369)
    a = np.tile(np.arange(0, 738, 2), suffix.MERGED_KEYS)
    tracemalloc.start()
    merged = suffix.merged_stretches(key, a, a + 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merged[0]) == len(key) and peak < 120 * len(key)


def _captured(spark, monkeypatch, made):
    """The function that ``made`` hands to mapInArrow."""
    held = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, *more: held.append(f) or self)
    made()
    return held[-1]


def _peak(run, batch):
    import tracemalloc

    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak


def test_a_batch_of_texts_is_looked_at_in_small_parts(spark, monkeypatch):
    """Arrow hands over 10,000 rows at a time; with all their texts as Python bytes and arrays over 4 MB a worker took 450 MB."""
    rng = np.random.default_rng(6)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(4000)]
    docs, number = spark.range(1).selectExpr("id as doc_id", "'' as text"), pa.array(range(len(texts)))
    spans = "array(struct(500L as a, 900L as b))"
    at = "array(struct(600L as pos, 5 as near, 9 as far, 1L as gram, x'00' as cls, 1L as n))"

    run = _captured(spark, monkeypatch, lambda: suffix.anchor_table(docs))
    rows, peak = _peak(run, pa.RecordBatch.from_arrays([number, number, pa.array(texts)], ["_id", "_hash", "text"]))
    assert rows > len(texts) and peak < 48 << 20

    listed = pa.array([[{"pos": 600, "near": 5, "far": 9, "gram": 1, "cls": b"0", "n": 1}]] * len(texts),
                      pa.list_(pa.struct([("pos", pa.int64()), ("near", pa.int32()), ("far", pa.int32()), ("gram", pa.int64()),
                                          ("cls", pa.binary()), ("n", pa.int64())])))
    wanted = docs.selectExpr("doc_id as _id", "xxhash64(text) as _hash", f"explode({at}) as s").select("_id", "_hash", "s.*")
    run = _captured(spark, monkeypatch, lambda: suffix._contexts(docs, wanted, 400))
    rows, peak = _peak(run, pa.RecordBatch.from_arrays([pa.array(texts), listed], ["text", "at"]))
    assert rows == len(texts) and peak < 12 << 20

    monkeypatch.setattr(suffix, "materialise", lambda df: df)
    monkeypatch.setattr(suffix, "repeated", lambda docs, *a: docs.selectExpr("doc_id as _id", "xxhash64(text) as _hash", f"{spans} as spans"))
    run = _captured(spark, monkeypatch, lambda: suffix.without_repeats(docs))
    gone = pa.array([[{"a": 500, "b": 900}]] * len(texts))
    rows, peak = _peak(run, pa.RecordBatch.from_arrays([number, pa.array(texts), gone], ["doc_id", "text", "spans"]))
    assert rows == len(texts) and peak < 12 << 20
