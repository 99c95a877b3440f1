from collections import Counter

import numpy as np
import pytest
import xxhash

from cardpulse.llm import simhash
from hostile import empty, hostile

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps))


def got(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(simhash.op1_simhash(spark, SF)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_hostile_rows(spark):
    docs = hostile(spark)
    assert got(simhash.near_duplicates(docs)) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(simhash.near_duplicates(empty(spark))) == Counter()


def test_pairs_are_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (1, 2, 2, 3, 4)]
    values = sorted({int(b) for b in base} | set(near))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    pairs = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    want = {frozenset((signed[i], signed[j])) for i in range(len(values)) for j in range(i) if 1 <= (values[i] ^ values[j]).bit_count() <= 2}
    assert len(pairs) == len(want) and {frozenset((r["a"], r["b"])) for r in pairs} == want


def test_every_word_has_one_home():
    words = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    row, _ = simhash.visits(words, 0)
    assert sorted(row.tolist()) == list(range(500))


def test_keep_one_keeps_one_of_each_group(spark):
    docs = hostile(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    root = plain_components([plain_fingerprint(t) for _, t in rows])
    left = [root[plain_fingerprint(r["text"])] for r in kept.collect()]
    assert sorted(left) == sorted(set(root[plain_fingerprint(t)] for _, t in rows))
    assert simhash.keep_one(empty(spark)).count() == 0
