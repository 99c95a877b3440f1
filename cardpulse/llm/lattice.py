"""Embedding near-duplicates by E8 lattice hashing.

Equal vectors of a label are one class.  In each of ``TABLES`` tables a class's unit vector is
projected by a random orthogonal map to ``BLOCKS`` groups of eight numbers, scaled, and every
group is decoded to the nearest point of the lattice E8; the label, table and lattice points are
the cell.  A class is filed under its own cell and looks into its own and the neighbouring cells
whose border lies within ``REACH`` of its projection, so that close vectors on two sides of a
border still meet.  A 128-bit sign sketch carried along drops pairs far from the threshold; the
pairs that remain are verified by cosine in double precision, and none below the threshold links.

The index holds every row; recall against brute force is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import checkpointed, components, materialise, table

THRESHOLD = 0.98
TABLES = 4
BLOCKS = 2
SCALE = 3.2
REACH = 0.30      # in lattice units; the minimal vectors have length sqrt(2)
SEED = 8
SKETCH_SIGMAS = 6.0


def _plus(axis: int, value: float) -> list[float]:
    v = [0.0] * 8
    v[axis] = value
    return v


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    from itertools import combinations, product

    pairs = [np.add(_plus(i, a), _plus(j, b)) for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves)


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer of the D8 points of x and of x - 1/2 shifted back."""

    def d8(y: np.ndarray) -> np.ndarray:
        f = np.rint(y)
        odd = np.nonzero(f.sum(axis=1) % 2)[0]
        if len(odd):
            gap = y[odd] - f[odd]
            worst = np.abs(gap).argmax(axis=1)
            g = gap[np.arange(len(odd)), worst]
            f[odd, worst] += np.where(g >= 0, 1.0, -1.0)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _maps(dim: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per table a projection to 8 * BLOCKS numbers with orthonormal rows (as far as dim allows), and the
    sketch's directions; all follow from the seed and the dimension."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(TABLES):
        q = np.linalg.qr(rng.standard_normal((max(dim, 8 * BLOCKS), 8 * BLOCKS)))[0][:dim]
        out.append(q * SCALE * np.sqrt(dim / 64.0))
    return out, rng.standard_normal((dim, 128))


def cells(unit: np.ndarray, label: np.ndarray, reach: float = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell key, is own cell) of every table's own cell and the neighbours within ``reach``."""
    import xxhash

    maps, _ = _maps(unit.shape[1])
    short = minimal_vectors()
    rows, keys, own = [], [], []
    for t, m in enumerate(maps):
        p = unit @ m
        options = []  # per block: row, lattice point (doubled, as int8), squared distance to its border
        for b in range(BLOCKS):
            x = p[:, 8 * b:8 * b + 8]
            home = decode(x)
            border = (1.0 - (x - home) @ short.T) / np.sqrt(2.0)
            r, k = np.nonzero(border <= reach)
            at = np.concatenate([np.arange(len(x)), r])
            point = np.concatenate([home, home[r] + short[k]])
            far = np.concatenate([np.zeros(len(x)), border[r, k] ** 2])
            order = np.argsort(at, kind="stable")
            options.append((at[order], np.rint(2 * point[order]).astype(np.int8), far[order]))
        at, points, far = options[0]
        points = points.reshape(len(at), -1)
        for at2, points2, far2 in options[1:]:
            n2 = np.bincount(at2, minlength=len(p))
            first2 = np.cumsum(n2) - n2
            n = n2[at]
            left = np.repeat(np.arange(len(at)), n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first2[at], n)
            d = far[left] + far2[right]
            ok = d <= reach ** 2
            left, right = left[ok], right[ok]
            at, far, points = at[left], d[ok], np.hstack([points[left], points2[right]])
        raw = np.ascontiguousarray(points).tobytes()
        w = points.shape[1]
        rows.append(at)
        own.append(far == 0)
        keys.append(np.array([xxhash.xxh64_intdigest(raw[i * w:i * w + w] + label[a], t) for i, a in enumerate(at.tolist())],
                             dtype=np.uint64).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _unit_rows(label: pa.Array, vectors: pa.Array) -> list[tuple[int, str, bytes]]:
    """(row, label, vector as bytes of doubles) of the rows that can link, -0.0 as 0.0."""
    out = []
    for i, (lab, v) in enumerate(zip(label.to_pylist(), vectors.to_pylist())):
        if lab is None or not v or any(c is None for c in v):
            continue
        x = np.asarray(v, np.float64) + 0.0
        if np.isfinite(x).all() and x.any():
            out.append((i, str(lab), x.tobytes()))
    return out


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, cls, label, unit): the class of each row's label and vector, null where it links with nothing."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("v"))
    schema = rows.select("vec_id", F.lit(None).cast("binary").alias("cls"), "label", F.lit(None).cast("binary").alias("vector")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            cls, raw = [None] * batch.num_rows, [None] * batch.num_rows
            for i, lab, x in _unit_rows(batch.column(1), batch.column(2)):
                raw[i] = x
                cls[i] = hashlib.blake2b(lab.encode() + b"\0" + x, digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), batch.column(1), pa.array(raw, pa.binary())],
                                             ["vec_id", "cls", "label", "vector"])

    return rows.mapInArrow(run, schema)


def _matrix(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(size):
        yield np.nonzero(size == n)[0]


def candidates(distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of classes that share a cell and whose sketches allow the threshold."""

    def send(reach: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    cls, label, raw = (batch.column(i).slice(lo, 1000).to_pylist() for i in range(3))
                    for at in _by_length(raw):
                        unit = _matrix([raw[i] for i in at])
                        labels = np.array([f"{len(raw[i])}:{label[i]}".encode() for i in at], dtype=object)
                        bits = np.packbits(unit @ _maps(unit.shape[1])[1] > 0, axis=1).view(np.int64)
                        r, key, own = cells(unit, labels, reach)
                        if reach == 0:
                            r, key = r[own], key[own]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key), pa.array([cls[i] for i in at[r]], pa.binary()), pa.array(bits[r, 0]), pa.array(bits[r, 1])],
                            ["cell", "cls", "s1", "s2"])

        return distinct.select("cls", "label", "vector").mapInArrow(run, "cell long, cls binary, s1 long, s2 long")

    share = float(np.arccos(min(1.0, max(-1.0, threshold))) / np.pi)
    most = int(np.ceil(128 * share + SKETCH_SIGMAS * np.sqrt(128 * share * (1 - share))))
    index = send(0.0).select(F.col("cell").alias("_cell"), F.col("cls").alias("_cls"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"))
    look = send(REACH)
    differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("_s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("_s2")))
    met = look.join(index, (F.col("cell") == F.col("_cell")) & (F.col("cls") != F.col("_cls")) & (differ <= most))
    return met.select(F.least("cls", "_cls").alias("a"), F.greatest("cls", "_cls").alias("b")).distinct()


def links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) verified: the candidates whose cosine in double precision is at least ``threshold``."""
    side = distinct.select("cls", "vector")
    both = (candidates(distinct, threshold)
            .join(side.select(F.col("cls").alias("a"), F.col("vector").alias("va")), "a")
            .join(side.select(F.col("cls").alias("b"), F.col("vector").alias("vb")), "b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                va, vb = part.column(2).to_pylist(), part.column(3).to_pylist()
                good = np.zeros(len(va), bool)
                for at in _by_length(va):
                    good[at] = np.einsum("ij,ij->i", _matrix([va[i] for i in at]), _matrix([vb[i] for i in at])) >= threshold
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "va", "vb").mapInArrow(verify, "a binary, b binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for every row of ``vectors``.

    Vectors link if their labels and lengths are equal, labels not null, and their cosine is at
    least ``threshold``.  Null, empty or zero vectors and those with null or non-finite components
    link with nothing.  Equal rows link with each other.  component_id is the least id reachable,
    the row's own id included; a null id counts as a vector but is never a component's name, so
    its kept is null, and where it stands alone its component_id is null as well.
    """
    rows = materialise(classes(vectors, id_col, vector_col, label_col))
    distinct = materialise(rows.where("cls is not null").groupBy("cls")
                           .agg(F.first("label").alias("label"), F.first("vector").alias("vector"),
                                F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")))
    pairs = materialise(links(distinct, threshold))
    counts = distinct.select("cls", "n")
    ends = pairs.union(pairs.select("b", "a")).toDF("a", "b")
    linked = (ends.join(counts.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.sum("n").alias("others")))
    comp = components(pairs)
    named = (distinct.join(comp, distinct["cls"] == comp["node"], "left")
             .select("cls", "n", "least", F.coalesce("component", "cls").alias("root"))
             .join(linked, F.col("cls") == F.col("a"), "left"))
    named = checkpointed(named.select("cls", "least", "root", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = checkpointed(named.join(roots, F.col("root") == F.col("_root")).select(F.col("cls").alias("_cls"), "n_links", "component_id"))
    out = rows.select("vec_id", "cls").join(named, F.col("cls") == F.col("_cls"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


# All pairs of a label; the exact links, of which the index must find nine in ten.
OP10_SQL = """
with recursive v as (
  select row_number() over () as rid, vec_id, label, embedding::double[] as e,
         label is not null and embedding is not null and len(embedding) > 0 and list_bool_and([x is not null and isfinite(x) for x in embedding])
         and list_bool_or([x <> 0 for x in embedding]) as able from embeddings),
pair as (
  select a.rid as a, b.rid as b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.rid <> b.rid
  where a.able and b.able and list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select rid as a, rid as b from v union select r.a, p.b from reach r join pair p on p.a = r.b),
comp as (select r.a, min(v.vec_id) as component_id from reach r join v on v.rid = r.b group by 1),
n as (select a, count(*) as n_links from pair group by 1)
select v.vec_id, coalesce(n.n_links, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join comp c on c.a = v.rid left join n on n.a = v.rid
"""
