import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cardpulse.llm import packing
from hostile import empty, hostile

SF = "/root/testdata/sf0.01"


def plain_best_two_fit(lengths, room):
    """Sequence by sequence over a list of lengths."""
    left, out = sorted(lengths), []
    while left:
        bin_, gap = [], room
        for size in sorted(left, reverse=True):
            if size <= gap:
                bin_.append(size)
                gap -= size
        for size in bin_:
            left.remove(size)
        if len(bin_) > 1:
            least, best = min(bin_), None
            distinct = sorted(set(left))
            for a in distinct:
                for b in distinct:
                    if b <= a and (a != b or left.count(a) > 1) and a + b <= gap + least and a + b > (sum(best) if best else least):
                        best = (a, b)
            if best:
                bin_.remove(least)
                left.append(least)
                for size in best:
                    left.remove(size)
                bin_ += best
        out.append(sorted(bin_))
    return out


def unfolded(slots):
    bins = defaultdict(list)
    for size, _, n, times, sequence, offset in slots:
        for r in range(times):
            bins[sequence + r] += [(offset + k * size, size) for k in range(n)]
    return [sorted(bins[k]) for k in sorted(bins)]


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_two_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(60, 1 + rng.geometric(0.06, 300)).tolist() + [60] * 7
    bins = unfolded(packing.plan(np.bincount(lengths, minlength=61), 60))
    sizes = [[size for _, size in b] for b in bins]
    want = plain_best_two_fit(lengths, 60)
    assert sorted(x for b in sizes for x in b) == sorted(lengths)
    assert len(sizes) == len(want) and [sum(b) for b in sizes] == [sum(b) for b in want]
    for b in bins:
        assert [o for o, _ in b] == [sum(s for _, s in b[:k]) for k in range(len(b))] and sum(s for _, s in b) <= 60


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(1)
    counts = np.concatenate([[0], rng.integers(1, 50, 1024)])
    few, many = packing.plan(counts), packing.plan(counts * 1_000_000_007)
    assert len(many) < 2 * len(few) + 20_000
    used = sum(size * n * times for size, _, n, times, _, _ in many)
    assert used == int((np.arange(1025) * counts).sum()) * 1_000_000_007


def check(rows, texts, length=1024):
    """Every text's ids are cut as the contract says, sequences are gapless and no longer than ``length``."""
    own = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t in texts:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= length
    return len(bins), sum(n for b in bins.values() for _, n in b)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = packing.op12_packing(spark, SF)
    bins, tokens = check(df.collect(), docs)
    assert bins <= -(-tokens // 1024) * 1.01 + 1
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
                               "sequence_id": "bigint", "offset": "bigint"}


def test_hostile_rows(spark):
    docs = hostile(spark)
    check(packing.pack(docs, length=64).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 64)
    assert packing.pack(empty(spark)).count() == 0


def test_sequences_hold_the_tokens(spark):
    docs = hostile(spark)
    rows = packing.sequences(docs, length=64).collect()
    own = Tokenizer.from_file(packing.default_tokenizer())
    tokens = sorted(i for r in docs.collect() for i in [*own.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    assert sorted(i for r in rows for i in r["ids"]) == tokens and max(len(r["ids"]) for r in rows) <= 64


def test_ids_equal_the_tokenizer_file():
    own, ids = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    for t in ["", " ", "a<|endoftext|>b", "x\n\n  y\t z　", "don't WE'LL it's 12345 ünïcödé \U0001f600‍", "\x00\x85᠎|", "汉字かな 한국어", "a" * 3000]:
        assert ids(t) == own.encode(t, add_special_tokens=False).ids
    other = packing.default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k")
    assert packing.encoder(other)("Some words") == Tokenizer.from_file(other).encode("Some words", add_special_tokens=False).ids
