"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased runs of letters and digits.  Seeds, the hashes of ``MIN_MATCH`` tokens in a
row, of documents and benchmark items are joined; a document and an item go on if the item's
shared seeds cover enough of its tokens for the threshold, which is an upper bound of what tiles
can cover.  Each such pair is tiled: the longest matches between unmarked tokens, found by running
Karp-Rabin hashes of falling length, are marked again and again until no match of ``MIN_MATCH``
tokens is left.  As tiles may lie in any order, a passage whose parts were reordered is caught;
the document is contaminated by the item if the tiles cover at least ``MIN_COVERAGE`` of it.

Neither the benchmark nor the candidates need fit in memory: what every task receives is a bit
table of fixed size that passes all seeds (or candidate texts) and few others, and the joins
behind it are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import checkpointed, materialise, slices, small, table

MIN_MATCH = 4
MIN_COVERAGE = 0.5
FILTER_BITS = 23
FIRST_LENGTH = 20
TOKEN = re.compile(r"[^\W_]+")
PRIME, BASE = (1 << 61) - 1, 1_000_003


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def token_hashes(words: list[str], memory: dict[str, int]) -> np.ndarray:
    import xxhash

    if len(memory) > 200_000:
        memory.clear()
    for w in set(words):
        if w not in memory:
            memory[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))


def seeds(h: np.ndarray, width: int = MIN_MATCH) -> np.ndarray:
    """A hash of every ``width`` tokens in a row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bit_table(df: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A table of 2**bits bits, that of each value's low bits set; its size does not depend on the data."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = (df.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect())
    out = bytearray(1 << (bits - 3))
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = r["m"]
    return bytes(out)


def passes(bits: np.ndarray, values: np.ndarray, n: int = FILTER_BITS) -> np.ndarray:
    slot = values & np.int64((1 << n) - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def item_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, pos, seed): the seeds of every benchmark row; item is its id and text hash as text."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1).to_pylist()):
                h = token_hashes(tokens(text), memory)
                s = seeds(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(s), batch.schema.field(0).type), pa.array([text] * len(s), pa.string()),
                     pa.array([len(h)] * len(s), pa.int32()), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)],
                    ["item_id", "item_text", "n", "pos", "seed"])

    schema = rows.select("item_id", F.col("text").alias("item_text"), F.lit(0).alias("n"), F.lit(0).alias("pos"),
                         F.lit(0).cast("long").alias("seed")).schema
    return rows.mapInArrow(run, schema)


def shared_seeds(docs: DataFrame, bits: bytes) -> DataFrame:
    """(_id, _hash, seed): the distinct seeds of each document that the bit table passes."""
    rows = docs.where("text is not null").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    schema = rows.select("_id", "_hash", F.lit(0).cast("long").alias("seed")).schema
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_bits, memory = np.frombuffer(shared.value, np.uint8), {}
        for batch in slices(batches):
            found, at = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                s = seeds(token_hashes(tokens(text), memory))
                s = np.unique(s[passes(table_bits, s)])
                found.append(s)
                at.append(np.full(len(s), i))
            where = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where),
                                              pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["_id", "_hash", "seed"])

    return rows.mapInArrow(run, schema)


def _matches(a: list[int], b: list[int], mark_a: list[bool], mark_b: list[bool], s: int) -> list[tuple[int, int, int]]:
    """Matches of at least ``s`` unmarked tokens that extend neither way, as (-length, place in a, place in b):
    the hashes of all runs of s tokens are kept running over both sides.

    A run of a is looked up by its hash and the token before it, so that of the many runs that a
    repetitive text shares only those come up that begin a match."""
    top = pow(BASE, s - 1, PRIME)

    def runs(x: list[int], marked: list[bool]) -> Iterator[tuple[int, int, int | None]]:
        h, free = 0, 0
        for i, t in enumerate(x):
            if marked[i]:
                h = free = 0
                continue
            if free >= s:
                h = (h - x[i - s] * top) % PRIME
            h = (h * BASE + t) % PRIME
            free += 1
            if free >= s:
                yield i - s + 1, h, x[i - s] if free > s else None

    places: dict[int, dict[int | None, list[int]]] = {}
    for i, h, before in runs(a, mark_a):
        places.setdefault(h, {}).setdefault(before, []).append(i)
    out = []
    for j, h, before in runs(b, mark_b):
        for earlier, at in places.get(h, {}).items():
            if earlier == before and before is not None:
                continue
            for i in at:
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not mark_a[i + k] and not mark_b[j + k]:
                    k += 1
                if k >= s:
                    out.append((-k, i, j))
                if k == len(a):     # the whole item: nothing is longer, nothing is left to cover
                    return [(-k, i, j)]
    return out


def tile(item: list[int], doc: list[int], least: int = MIN_MATCH, first: int = FIRST_LENGTH) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in doc), none overlapping another on either side: again and again the
    longest match of unmarked tokens is marked (of equals the first in the item, then in the
    document), as long as it has ``least`` tokens.  Hash lengths fall from ``first`` to ``least``; what marks leave of a
    match goes back among the others."""
    mark_a, mark_b, tiles = [False] * len(item), [False] * len(doc), []
    s = max(least, min(first, len(item)))
    while True:
        heap = _matches(item, doc, mark_a, mark_b, s)
        if heap and -min(heap)[0] > 2 * s:
            s = -min(heap)[0]
            heap = [m for m in heap if -m[0] >= s]
        heapify(heap)
        while heap:
            k, i, j = heappop(heap)
            free = [not mark_a[i + x] and not mark_b[j + x] for x in range(-k)]
            if all(free):
                mark_a[i:i - k] = mark_b[j:j - k] = [True] * -k
                tiles.append((-k, i, j))
                continue
            lo = 0
            for x, open_ in enumerate([*free, False]):
                if not open_:
                    if x - lo >= s:
                        heappush(heap, (lo - x, i + lo, j + lo))
                    lo = x + 1
        if s == least or all(mark_a):
            return tiles
        s = max(least, s // 2)


def _relevant(item: list[int], doc: list[int], least: int) -> list[int]:
    """The runs of at least ``least`` tokens of the document that all occur in the item, parted by -1; what
    falls away can be in no tile."""
    known, out, run = set(item), [], []
    for t in [*doc, -1]:
        if t in known:
            run.append(t)
            continue
        if len(run) >= least:
            out += run
            out.append(-1)
        run = []
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, text_hash, item_id, item_tokens, covered, n_tiles, coverage): the documents and benchmark items of
    which tiles cover at least ``least``.

    Null and blank texts on either side match nothing, nor do items of fewer than ``MIN_MATCH`` tokens;
    equal rows give one row; null ids are kept; no rows give no rows; other columns are not read.
    """
    items = materialise(item_seeds(benchmark))
    survivors = shared_seeds(docs, bit_table(items, "seed"))
    met = survivors.join(items.select("item_id", "item_text", "n", "pos", F.col("seed").alias("_seed")), F.col("seed") == F.col("_seed"))
    per = met.groupBy("_id", "_hash", "item_id", "item_text", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # tokens under the shared seeds: a seed adds MIN_MATCH tokens, or its distance from the seed before if that is less
    covered = F.aggregate("at", F.struct(F.lit(0).alias("sum"), F.lit(-MIN_MATCH).alias("last")), lambda s, p: F.struct(
        (s["sum"] + F.least(p - s["last"], F.lit(MIN_MATCH))).alias("sum"), p.alias("last")), lambda s: s["sum"])
    pairs = (per.where(covered >= F.col("n") * least).groupBy("_id", "_hash")
             .agg(F.collect_set(F.struct("item_id", "item_text")).alias("items")))
    pairs = checkpointed(pairs)
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(pairs, "_hash"))

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd
        return pd.Series(passes(np.frombuffer(shared.value, np.uint8), h.to_numpy(dtype=np.int64)))

    rows = docs.where("text is not null").select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    both = (rows.where(maybe("text_hash")).join(pairs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
            .select("doc_id", "text_hash", "text", "items"))
    schema = both.select("doc_id", "text_hash", F.col("items")[0]["item_id"].alias("item_id"), F.lit(0).alias("item_tokens"),
                         F.lit(0).alias("covered"), F.lit(0).alias("n_tiles"), F.lit(0.0).alias("coverage")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for i, (text, items) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                doc = token_hashes(tokens(text), memory).tolist()
                for item in items:
                    want = token_hashes(tokens(item["item_text"]), memory).tolist()
                    got = tile(want, _relevant(want, doc, MIN_MATCH))
                    n = sum(k for k, _, _ in got)
                    if n >= least * len(want):
                        out.append((ids[i], batch.column(1)[i].as_py(), item["item_id"], len(want), n, len(got), n / len(want)))
            if out:
                cols = list(zip(*out))
                kinds = [batch.schema.field(0).type, pa.int64(), batch.schema.field(3).type.value_type.field("item_id").type, pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema.names)

    return both.mapInArrow(run, schema).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = checkpointed(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return (rows.join(small(bad), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_anti")
            .select("row.*"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
