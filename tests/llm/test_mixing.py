import numpy as np

from cardpulse.llm import mixing
from hostile import empty, hostile

SF = "/root/testdata/sf0.01"


def plain_targets(sizes):
    """Water filling, one source at a time."""
    w = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    out, capped, total = [0.0] * len(sizes), set(), float(sum(sizes))
    while len(capped) < len(sizes):
        rest = total - sum(3.0 * sizes[i] for i in capped)
        free = sum(w[i] for i in range(len(sizes)) if i not in capped)
        over = [i for i in range(len(sizes)) if i not in capped and rest * w[i] / free >= 3.0 * sizes[i]]
        if not over:
            return [3.0 * sizes[i] if i in capped else rest * w[i] / free for i in range(len(sizes))]
        capped |= set(over)
    return [3.0 * s for s in sizes]


def check(df, docs, near=0.05):
    rows = df.collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, plain_targets([sizes[s] for s in names])))
    for s in names:
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= near * want[s] + mixing.BLOCK
    return rows


def test_targets_are_met_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = check(mixing.op5_mixing(spark, SF), docs, near=0.01)
    again = mixing.mixing_report(docs.repartition(5)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    sizes = {r["doc_id"]: r["size"] for r in first}
    assert all(sizes[r["doc_id"]] == len((r["text"] or "").encode().split()) for r in docs.collect())


def test_caps(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (n, s) in enumerate([(40, "a"), (3000, "b"), (2500, "b"), (10, "c"), (0, "d")])],
                                 "doc_id long, text string, source string")
    rows = check(mixing.mixing_report(docs), docs)
    assert {r["doc_id"]: r["taken"] for r in rows}[0] == 120


def test_hostile_rows(spark):
    docs = hostile(spark)
    check(mixing.mixing_report(docs), docs)
    assert mixing.mixing_report(empty(spark)).count() == 0


def test_pieces_cover_whole_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed, mixed, mix = mixing.mix_blocks(docs)
    per = mixed.groupBy("shard", "source_no", "block_no").sum("words").collect()
    assert max(r[3] for r in per) <= 64 * 3
    n = mixed.select("shard").distinct().count()
    assert n == -(-int(mix["slots"].sum()) // mixing.SHARD_SLOTS)


def test_permutation():
    for n in (1, 2, 3, 64, 1000):
        k = np.arange(n)
        out = mixing.permuted(k, np.full(n, n), np.full(n, 77))
        assert sorted(out.tolist()) == list(range(n))


def test_blocks_are_packed_from_the_texts(spark):
    """Blocks hold the words of their source's stream, and what the report says was taken is what the mix holds."""
    from collections import Counter, defaultdict
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    streams = defaultdict(list)
    for i, text, source in sorted(rows, key=lambda r: r[0]):
        streams[source] += [(i, w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    slots = mixing.mixed_blocks(docs, shard_slots=64).collect()
    taken, used = Counter(), defaultdict(Counter)
    for s in slots:
        lo = s["block_no"] * mixing.BLOCK
        want = streams[s["source"]][lo:lo + mixing.BLOCK]
        assert s["words"] == [w for _, w in want]
        owners = [p["doc_id"] for p in s["parts"] for _ in range(p["words"])]
        assert owners == [i for i, _ in want]
        taken.update(owners)
        used[s["source"]][s["block_no"]] += 1
    assert len({(s["source"], s["slot"]) for s in slots}) == len(slots)
    shards = Counter(s["shard"] for s in slots)
    assert sorted(shards.values(), reverse=True)[:-1] == [64] * (len(shards) - 1) and max(shards.values()) <= 64
    assert all(max(c.values()) - min(c.values()) <= 1 or len(c) < -(-len(streams[k]) // mixing.BLOCK) for k, c in used.items())
    report = {r["doc_id"]: r for r in mixing.mixing_report(docs).collect()}
    full = Counter()
    for s in mixing.mixed_blocks(docs).collect():
        for p in s["parts"]:
            full[p["doc_id"]] += p["words"]
    assert {i: r["taken"] for i, r in report.items()} == {i: full[i] for i in report}


def test_blocks_of_hostile_rows(spark):
    docs = hostile(spark)
    total = sum(len(s["words"]) for s in mixing.mixed_blocks(docs, block=8).collect())
    assert total > 0 and mixing.mixed_blocks(empty(spark)).count() == 0
