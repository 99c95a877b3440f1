import numpy as np

from cardpulse.llm import decontaminate
from hostile import empty, hostile

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghij"), 4)) for _ in range(3000)]
ITEMS = [(i, " ".join(RNG.choice(WORDS, 40))) for i in range(8)]


def noise(n):
    return " ".join(RNG.choice(WORDS, n))


def naive_tiles(a, b, least):
    """Greedy string tiling by looking at all places."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                best.append((k, i, j))
        k, i, j = max(best, key=lambda m: (m[0], -m[1], -m[2]), default=(0, 0, 0))
        if k < least:
            return total
        for x in range(k):
            ma[i + x] = mb[j + x] = True
        total += k


def test_tiles_against_naive_tiling():
    rng = np.random.default_rng(2)
    for _ in range(400):
        a, b = rng.integers(0, 6, rng.integers(0, 30)).tolist(), rng.integers(0, 6, rng.integers(0, 40)).tolist()
        got = decontaminate.tile(a, b, 3, 8)
        assert all(a[i:i + k] == b[j:j + k] and k >= 3 for k, i, j in got)
        used_a, used_b = [i + x for k, i, _ in got for x in range(k)], [j + x for k, _, j in got for x in range(k)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert sum(k for k, _, _ in got) == naive_tiles(a, b, 3)
        relevant = decontaminate._relevant(a, b, 3)
        assert sum(k for k, _, _ in decontaminate.tile(a, relevant, 3, 8)) == sum(k for k, _, _ in got)


def planted():
    words = [t.split() for _, t in ITEMS]
    reordered = words[2][25:] + words[2][12:25] + words[2][:12]
    half = words[3][:24]
    few = words[4][:10]
    return [
        (1, noise(200) + " " + ITEMS[0][1].upper() + ". " + noise(100)), (2, ITEMS[1][1].replace(" ", ", ")),
        (3, noise(50) + " " + " ".join(reordered) + " " + noise(2000)), (4, " ".join(half)), (5, noise(300) + " " + " ".join(few)),
        (6, noise(5000)), (7, ITEMS[0][1] + " " + ITEMS[5][1]), (8, None), (9, ""),
    ]


def test_planted_passages(spark):
    docs = hostile(spark, [(i, t, "en", "s") for i, t in planted()])
    bench = spark.createDataFrame([*ITEMS, (None, None), (90, ""), (91, "three short words"), (5, ITEMS[5][1])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (3, 2), (4, 3), (7, 0), (7, 5)}
    assert found[(3, 2)]["n_tiles"] == 3 and found[(3, 2)]["coverage"] == 1.0 and found[(4, 3)]["covered"] == 24
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 8, 9]


def test_hostile_rows(spark):
    docs = hostile(spark)
    bench = spark.createDataFrame([(1, "no id here but some words to read"), (1, "no id here but some words to read")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(None, 1)]
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() - 1
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_bit_table_passes_all_values(spark):
    values = RNG.integers(-(1 << 62), 1 << 62, 2000)
    bits = np.frombuffer(decontaminate.bit_table(spark.createDataFrame([(int(v),) for v in values], "v long"), "v"), np.uint8)
    assert decontaminate.passes(bits, values).all()
    assert decontaminate.passes(bits, RNG.integers(-(1 << 62), 1 << 62, 10_000)).mean() < 0.01


def test_repetitive_texts_take_time_by_their_length():
    import time
    began = time.perf_counter()
    assert decontaminate.tile([7] * 50, [7] * 250_000) == [(50, 0, 0)]
    two = decontaminate.tile([7] * 30 + [8] * 20, [7] * 200_000)
    assert two == [(30, 0, 0)]
    cycle = decontaminate.tile([1, 2, 3, 4, 5] * 10 + [9], [1, 2, 3, 4, 5] * 40_000)
    assert cycle == [(50, 0, 0)]
    assert time.perf_counter() - began < 20


def test_a_long_text_of_one_token(spark):
    docs = hostile(spark, [(1, "la " * 330_000, "en", "s"), (2, noise(50), "en", "s")])
    bench = spark.createDataFrame([(1, "la " * 40), (2, " ".join(WORDS[:30]))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["covered"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1, 40)]


def test_joins_find_what_all_pairs_find(spark):
    """Seed join, bound and tiling against naive tiling of every document with every item."""
    rng = np.random.default_rng(8)
    few = WORDS[:60]
    items = [(i, " ".join(rng.choice(few, int(rng.integers(2, 30))))) for i in range(12)]
    docs = []
    for i in range(60):
        words = list(rng.choice(few, int(rng.integers(0, 60))))
        if i % 2:
            part = items[i % 12][1].split()
            cut = int(rng.integers(0, len(part)))
            words[3:3] = part[cut:] + part[:cut // 2]
        docs.append((i, " ".join(words), "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in decontaminate.contaminated(hostile(spark, docs), bench).collect()}
    want = set()
    for d, text, _, _ in docs:
        for i, item in items:
            a, b = item.split(), text.split()
            n = naive_tiles(a, b, decontaminate.MIN_MATCH)
            if n >= decontaminate.MIN_COVERAGE * len(a) and n:
                want.add((d, i, n))
    assert got == want and len(want) > 10
