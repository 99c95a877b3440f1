"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints.  A text is lower-cased in A-Z, cut into words at ASCII blanks, and each run of
three words (all words, if fewer) is hashed with XXH64 (seed 42).  A bit is set if it is set in
more than half of the hashes; a text without words has fingerprint zero.

Candidates.  The 64 bits are read as two 23-bit blocks and 18 free bits.  The anchors are the
words of the perfect binary Golay code in each block (covering radius 3) with the free bits at
zero: every fingerprint has exactly one home anchor.  Two fingerprints that differ in t1 and t2
bits of the blocks, t1 + t2 <= 2, are both within (3 + t1, 3 + t2) of the home of either, so
sending each fingerprint to all anchors within covering radius plus threshold brings every pair
together at a home (about 61 of 16.7 million anchors per fingerprint).  At an anchor only its
home fingerprints are compared with the visitors.  The search is exact.

Equal fingerprints are one row before anything is linked, so a group of copies is never paired,
and a fingerprint has at most 2,080 others within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import checkpointed, components, slices, table, utf8_rows

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
# Generator polynomial and length of the binary Golay code.
GOLAY_POLY, GOLAY_BITS, GOLAY_CHECK = 0xAE3, 23, 11
COVERING_RADIUS = 3
CHUNK = 1 << 15  # shingles hashed at a time


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    width = min(width, len(words))
    n = len(words) - width + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        hashes = b"".join([digest(joined[s:e], SEED)
                           for s, e in zip(starts[lo:hi].tolist(), (ends[lo + width - 1:hi + width - 1] - 1).tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) for every row, fp as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    schema = rows.select("doc_id", "text_hash", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, width) for t in utf8_rows(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                                             ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, schema)


def _remainders() -> np.ndarray:
    """Syndrome of every 23-bit word: its remainder by the generator polynomial."""
    rem = np.arange(1 << GOLAY_BITS, dtype=np.uint32)
    for bit in range(GOLAY_BITS - 1, GOLAY_CHECK - 1, -1):
        hit = (rem >> np.uint32(bit)) & np.uint32(1)
        rem ^= hit * np.uint32(GOLAY_POLY << (bit - GOLAY_CHECK))
    return rem.astype(np.uint16)


def _error_table(most: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Syndromes, and per syndrome the error words of weight up to 3 + most with their level
    (weight above the covering radius): word ^ error runs over the anchors within that radius."""
    from itertools import combinations

    rem = _remainders()
    words = np.array([sum(1 << i for i in c) for w in range(COVERING_RADIUS + most + 1)
                      for c in combinations(range(GOLAY_BITS), w)], dtype=np.uint32)
    weight = np.array([w for w in range(COVERING_RADIUS + most + 1)
                       for _ in combinations(range(GOLAY_BITS), w)])
    level = np.maximum(weight - COVERING_RADIUS, 0)
    order = np.argsort(rem[words], kind="stable")
    cuts = np.searchsorted(rem[words][order], np.arange(1, 1 << GOLAY_CHECK))
    return rem, np.split(words[order], cuts), np.split(level[order], cuts)


def visits(fp: np.ndarray, most: int, tables: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius plus ``most`` of each fingerprint."""
    rem, errors, levels = tables or _error_table(most)
    mask = np.uint64((1 << GOLAY_BITS) - 1)
    halves = [((fp >> np.uint64(s)) & mask).astype(np.uint32) for s in (0, GOLAY_BITS)]
    widest = max(map(len, errors))
    pad_e = np.zeros((len(errors), widest), np.uint32)
    pad_l = np.full((len(errors), widest), most + 1, np.int8)
    for i, (e, v) in enumerate(zip(errors, levels)):
        pad_e[i, :len(e)], pad_l[i, :len(e)] = e, v
    first, second = ((h[:, None] ^ pad_e[rem[h]], pad_l[rem[h]]) for h in halves)
    rows, anchors = [], []
    for j in range(widest):  # one anchor of the first block against all of the second
        total = first[1][:, j, None] + second[1]
        r, k = np.nonzero(total <= most)
        rows.append(r)
        anchors.append((first[0][r, j].astype(np.int64) << GOLAY_BITS) | second[0][r, k])
    return np.concatenate(rows), np.concatenate(anchors)


def near_pairs(distinct: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(a, b) for all distinct fingerprints ``fp`` that differ in 1 to ``most`` bits, once each."""

    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")

    def send(reach: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _error_table(reach)
            for batch in batches:
                fp = batch.column(0).to_numpy(zero_copy_only=False)
                for lo in range(0, len(fp), 2000):
                    part = fp[lo:lo + 2000]
                    r, anchor = visits(part.view(np.uint64), reach, tables)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[r])], ["anchor", "fp"])

        return spread.mapInArrow(run, "anchor long, fp long")

    home = send(0).select(F.col("anchor").alias("home"), F.col("fp").alias("a"))
    visitor = send(most).select("anchor", F.col("fp").alias("b"))
    return (visitor.join(home, (F.col("home") == F.col("anchor")) & (F.col("a") < F.col("b"))
                         & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
            .select("a", "b"))


def _classes(prints: DataFrame, most: int) -> DataFrame:
    """(fp, root): the component of every distinct fingerprint, named by its least fingerprint."""
    distinct = checkpointed(prints.select("fp").distinct())
    comp = components(near_pairs(distinct, most))
    return distinct.join(comp, distinct["fp"] == comp["node"], "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for every row of ``docs``.

    component_id is the least id reachable over fingerprints at ``most`` bits or fewer.  Null and
    blank texts have fingerprint zero and link like any other; rows with a null id are kept and
    share their component; repeated rows stay repeated; no rows give no rows; other columns of
    ``docs`` are not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, width).drop("text_hash"))
    classes = checkpointed(_classes(prints, most))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, F.col("fp") == F.col("_fp"))
    roots = least.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    named = checkpointed(classes.join(roots, F.col("root") == F.col("_root")).select("_fp", "component_id"))
    return (prints.join(named, prints["fp"] == named["_fp"])
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, most: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row left of each near-duplicate group: the row of the least id (a null id
    counts as largest; ties go to the least text hash).  Rows keep all their columns."""
    prints = checkpointed(fingerprints(docs, width=width))
    classes = _classes(prints, most)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    stays = (prints.groupBy("fp").agg(F.min(first).alias("first")).join(classes, F.col("fp") == F.col("_fp"))
             .groupBy("root").agg(F.min("first").alias("first"))
             .select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    return (rows.join(checkpointed(stays).hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_text")), "left_semi")
            .dropDuplicates(["id", "hash"]).select("row.*"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
