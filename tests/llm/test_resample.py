import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cardpulse.llm import resample
from hostile import empty, hostile

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").encode().lower())


def plain_features(text, ngram=1):
    w = plain_words(text)
    return [b" ".join(w[i:i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]


def expected(docs, target, ngram=1, buckets=10_000, least=20, percent=10):
    def totals(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in plain_features(t, ngram))

    s, t = totals([x for _, x in docs]), totals(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = plain_features(text, ngram)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    return Counter([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in out if r[4] < least])


def got(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())


def texts(df):
    return [r["text"] for r in df.collect()]


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()], texts(target))
    df = resample.op13_resample(spark, SF)
    assert got(df) == want
    assert [t for _, t in df.dtypes] == ["bigint"] * 5


def test_runs_of_words(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet").limit(60), hostile(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(resample.importance(kept, target, ngram=3, buckets=500, percent=30)) == expected(rows, texts(target), 3, 500, 20, 30)


def test_hostile_rows(spark):
    docs = hostile(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = hostile(spark, [(1, "the lazy dog", "en", "a"), (2, None, "en", "a")])
    assert got(resample.importance(docs, target, least_words=1, percent=50)) == expected(rows, texts(target), least=1, percent=50)
    assert got(resample.importance(docs, empty(spark), least_words=5, percent=50)) == expected(rows, [], least=5, percent=50)
    assert resample.importance(empty(spark), target).count() == 0


def test_drawn_rows_keep_their_columns(spark):
    docs = hostile(spark).withColumnRenamed("score", "rank")
    drawn = resample.resample(docs, hostile(spark), least_words=1, percent=50)
    assert drawn.columns == [*docs.columns, "rank_"]
    assert 0 < drawn.count() < docs.count()


def test_bit_planes_are_exact():
    rng = np.random.default_rng(3)
    gain = rng.integers(-20_000, 20_000, 1000)
    plus, minus = resample.gain_planes(gain)
    dense = rng.integers(0, 4, (50, 1000)) * rng.integers(0, 2, (50, 1000))
    dense[7, 3] = 1_000_003
    row, bucket = np.nonzero(dense)
    got = resample.weights(row, bucket, dense[row, bucket], 50, 1000, plus, minus)
    assert (got == dense @ gain).all()
    assert resample.gain_planes(np.zeros(10, np.int64))[0].any() == False  # noqa: E712


def test_words_are_cut_as_bytes():
    text = "Été_ÀB 12ab\x00x  ÿ"
    row, _, _ = resample.features(pa.array([text, None, "", "a"]))
    assert np.bincount(row, minlength=4).tolist() == [len(plain_words(text)), 0, 0, 1]
