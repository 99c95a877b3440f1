import numpy as np

from cardpulse.llm import lattice

SF = "/root/testdata/sf0.01"


def expected(rows):
    """n_links and component of every row, by all pairs."""
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and lab is not None for _, v, lab in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if o else None for (_, v, _), o in zip(rows, ok)]
    unit = [u / np.sqrt(u @ u) if u is not None else None for u in unit]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(((rows[i][0], links[i], least.get(find(i))) for i in range(len(rows))), key=str)


def got(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=str)


def synthetic(seed, n=300, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = rng.standard_normal(dim)
        out.append(c)
        for _ in range(int(rng.integers(0, 6))):
            out.append(c + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.1, 0.14, 0.18, 0.2]))
    return [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(out)]


def test_recall_against_brute_force(spark):
    rows = synthetic(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want, have = expected(rows), got(lattice.near_duplicates(df))
    total = sum(w[1] for w in want)
    assert sum(h[1] for h in have) >= 0.995 * total and all(h[1] <= w[1] for h, w in zip(have, want))


def test_registered_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(lattice.op10_lattice(spark, SF)) == expected(rows)


def test_hostile_rows(spark):
    e = [1.0] + [0.0] * 7
    rows = [(1, e, 0), (2, e, 0), (2, e, 0), (3, e, None), (4, e, 1), (5, None, 0), (6, [0.0] * 8, 0), (7, [None] + e[1:], 0),
            (8, [float("nan")] + e[1:], 0), (9, [float("inf")] + e[1:], 0), (None, e, 0), (10, e[:3], 0), (11, [], 0), (12, [1e300] * 8, 0),
            (13, [1e-300] * 8, 0), (14, [-0.0 if x == 0 else x for x in e], 0), (None, [0.0] * 8, 0)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, label int, cls string, n string")
    assert got(lattice.near_duplicates(df)) == expected(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in lattice.near_duplicates(df).where("vec_id is not null").collect())
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (400, 8))
    home = lattice.decode(x)
    short = lattice.minimal_vectors()
    d = ((x - home) ** 2).sum(axis=1)
    assert len(short) == 240 and (d <= 1 + 1e-9).all()
    assert all(((x[i] - home[i] - short) ** 2).sum(axis=1).min() >= d[i] - 1e-9 for i in range(len(x)))
