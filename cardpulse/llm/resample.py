"""Importance resampling towards a target distribution by bit-sliced aggregation.

Texts are lower-cased in A-Z and cut into words of digits, a-z and bytes above 0x7F; features are
all runs of 1 to ``NGRAM`` words, hashed by CRC32 into ``BUCKETS`` buckets.  One pass counts every
bucket over all documents, another over the target texts; a bucket's gain is the floor of 1000
times the log ratio of its smoothed shares.

A document's weight, the sum of the gains of its features, is taken bit by bit: its bucket counts
are written as planes of ``BUCKETS`` bits (plane i holds bit i of each count), the gains as planes
of their magnitudes' bits, positive and negative ones apart.  A count plane ANDed with a gain plane
has as many ones as there are buckets in which both bits are set, so the sum over all pairs of
planes of popcount times 2**(i + j), signed, is the exact weight.

Weights plus Gumbel noise from a hash of the id give scores whose highest are a draw without
replacement.  What reaches the driver is two counts per bucket.  Ranks are running sums over range
partitions, so no task holds more than a share of the scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import fresh, materialise, running_sum, table
from cardpulse.llm.words import byte_classes, chunks, distinct, phrases, split

NGRAM = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
ROWS = 256               # documents whose planes are held at a time
NO_WORD = byte_classes(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def features(texts: pa.Array, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, whether it is a single word) of every feature of ``texts``, repeats included."""
    words = split(texts, NO_WORD)
    rows, found, single = [], [], []
    for n in range(1, ngram + 1):
        at = np.arange(max(0, len(words.codes) - n + 1))
        at = at[words.row[at] == words.row[at + n - 1]]
        if not len(at):
            break
        if n == 1:
            ids, texts_of = words.codes, words.vocabulary
        else:
            ids, where, _ = distinct(words, at, n)
            texts_of = phrases(words, where, n)
        of = np.fromiter(map(zlib.crc32, texts_of.to_pylist()), np.int64, len(texts_of)) % buckets
        rows.append(words.row[at])
        found.append(of[ids])
        single.append(np.full(len(at), n == 1))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (rows, found, single))


def bucket_totals(df: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket over all texts of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in chunks(batches):
            total += np.bincount(features(part.column(0), ngram, buckets)[1], minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counts = df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, :bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the magnitudes of positive and of negative gains."""
    depth = max(1, int(np.abs(gain).max(initial=0)).bit_length())
    bits = (np.abs(gain)[None, :] >> np.arange(depth)[:, None]) & 1 == 1
    return _packed(bits & (gain > 0)), _packed(bits & (gain < 0))


def weights(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n_rows: int, buckets: int,
            plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    """Exact sums of count times gain over the buckets of each of ``n_rows`` rows (row, bucket distinct)."""
    out = np.zeros(n_rows, np.int64)
    i = 0
    while len(count) and (count >> i).any():
        on = (count >> i) & 1 == 1
        rows, at = np.unique(row[on], return_inverse=True)
        bits = np.zeros((len(rows), buckets), bool)
        bits[at, bucket[on]] = True
        plane = _packed(bits)
        for j in range(len(plus)):
            ones = (np.bitwise_count(plane & plus[j]).sum(axis=1, dtype=np.int64)
                    - np.bitwise_count(plane & minus[j]).sum(axis=1, dtype=np.int64))
            out[rows] += ones << (i + j)
        i += 1
    return out


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight), one row for every row of ``docs``."""
    buckets = len(gain)
    rows = docs.select("doc_id", F.col(text_col).alias("text"))
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")]).schema
    planes = docs.sparkSession.sparkContext.broadcast(gain_planes(gain))   # its size follows from the buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = planes.value
        for part in chunks(batches):
            row, bucket, single = features(part.column(1), ngram, buckets)
            n = part.num_rows
            key, count = np.unique(row * buckets + bucket, return_counts=True)
            at, bucket = key // buckets, key % buckets
            weight = np.zeros(n, np.int64)
            for lo in range(0, n, ROWS):
                a, b = np.searchsorted(at, [lo, lo + ROWS])
                weight[lo:lo + ROWS] = weights(at[a:b] - lo, bucket[a:b], count[a:b], min(ROWS, n - lo), buckets, plus, minus)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(x.astype(np.int64)) for x in
                                   (np.bincount(row[single.astype(bool)], minlength=n), np.bincount(row, minlength=n), weight)]],
                ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, schema)


def importance(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS,
               least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for every row of ``docs`` (doc_id, text).

    ``rank`` numbers the drawn rows by falling score, ties by rising doc_id; it is null for the
    others.  Null and blank texts have no feature, weight 0 and are never drawn; a null doc_id
    hashes like an empty text and comes after others of its score; repeated rows have equal scores
    and ranks of their own; an empty target is a target without features; no rows give no rows;
    other columns are not read.
    """
    gain = gains(bucket_totals(docs, ngram=ngram, buckets=buckets), bucket_totals(target, ngram=ngram, buckets=buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8),
               16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weighted(docs, gain, ngram=ngram).withColumn("score", F.col("weight") + noise))
    eligible = scored.where(F.col("n_words") >= least_words).withColumns(
        {"_all": F.lit(0), "_one": F.lit(1).cast("long"), "_down": -F.col("score"), "_no_id": F.col("doc_id").isNull()})
    drawn = eligible.count() * percent // 100
    ranked = running_sum(eligible, "_all", ["_down", "_no_id", "doc_id"], "_one", "_before")
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("_before") < drawn, F.col("_before") + 1).alias("rank")
    short = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, rank).union(short)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns and a column ``rank`` (or ``rank_`` where taken).

    Rows are drawn by id: of rows that share a drawn id, all come, each with the best rank of that id.
    """
    name = fresh(docs, "rank")
    best = (importance(docs, target, **options).where("rank is not null")
            .groupBy(F.col("doc_id").alias("_drawn")).agg(F.min("rank").alias("_rank")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_of"))
    return (rows.join(best, F.col("_of").eqNullSafe(F.col("_drawn")))
            .select("_row.*", F.col("_rank").alias(name)))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with crc as (
  select [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)
          for n in range(256)] as step),
d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
b as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
dw as (select rid, unnest(ws) as word from d),
bw as (select unnest(ws) as word from b),
words as (select word, hex(encode(word)) as h from (select word from dw union select word from bw)),
bucket as (
  select word, xor(list_reduce(list_concat([4294967295], [cast('0x' || substr(h, 2 * i - 1, 2) as bigint) for i in range(1, len(h) // 2 + 1)]),
                               lambda c, x: xor(step[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket
  from words, crc),
s as (select bucket, count(*) as n from dw join bucket using (word) group by 1),
t as (select bucket, count(*) as n from bw join bucket using (word) group by 1),
total as (select (select count(*) from dw) as s_all, (select count(*) from bw) as t_all),
gain as (
  select r.i as bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * (s_all + 10000) / ((coalesce(s.n, 0) + 1.0::double) * (t_all + 10000)))) as bigint) as g
  from range(10000) r(i) cross join total left join s on s.bucket = r.i left join t on t.bucket = r.i),
w as (select rid, cast(sum(g) as bigint) as weight from dw join bucket using (word) join gain using (bucket) group by 1),
scored as (
  select rid, doc_id, cast(len(ws) as bigint) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from d left join w using (rid)),
able as (select rid, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank from scored left join able using (rid)
"""
