"""Mixing sources to target weights by blocks.

Every source's words form one stream (documents in id order) that is cut into blocks of
``BLOCK`` words.  The mix has a number of slots per source that follows from its target.  Slots
are dealt to output shards: each shard draws the source counts of its slots from a multinomial
distribution; what a source draws beyond its slots goes to the sources left short, so the totals
are exact.  A source's slots are numbered over all shards, and slot k maps to block
perm(k mod blocks), perm a keyed Feistel permutation of the block numbers that differs in every
round through the source: a source is read evenly and a block is taken floor or ceil of
slots / blocks times.  Slots and blocks then meet in an equi-join on (source, block).

``mixed_blocks`` packs the blocks from the texts' words and joins them to the slots: the mix itself.
For reports only numbers move, (document, size) and (slot, block) rows.  A source's positions
are running sums over range partitions, so one source may hold any share of the rows.  The one
thing gathered at the driver is the mixture itself, one row per source name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import materialise, running_sum, table

BLOCK = 64
SHARD_SLOTS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
SEED = 20260
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_EPOCHS) -> np.ndarray:
    """Shares of all words by weight; a source stops at ``most`` times its size and the excess is
    shared again by weight among the others."""
    total, cap = float(sizes.sum()), most * sizes.astype(float)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        share = (total - cap[~free].sum()) * weights / weights[free].sum()
        over = free & (share >= cap)
        if not over.any():
            out[free] = share[free]
            break
        free &= ~over
    out[~free] = cap[~free]
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n), evaluated at each k (arrays of equal length):
    a balanced Feistel network on the next even number of bits, walked until it falls in range."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = key.astype(np.uint64)

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        h, m, s, x = half[todo], mask[todo], key[todo], out[todo]
        left, right = x >> h, x & m
        for r in range(rounds):
            left, right = right, left ^ (mix(right + s * np.uint64(2 * r + 3) + np.uint64(r)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def document_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     source_col: str = "source", with_text: bool = False) -> DataFrame:
    """(doc_id, source, size, start[, text]): each document's place in its source's stream of words."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        n_words(F.col(text_col)).alias("size"), *[F.col(text_col).alias("text")] * with_text)
    return materialise(running_sum(materialise(sizes), "source", ["doc_id", "size"], "size", "start"))


def mixture(placed: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS,
            block: int = BLOCK) -> pd.DataFrame:
    """One row per source, by code point with null last: size, target, blocks and slots."""
    rows = placed.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    out = pd.DataFrame({"source": [r["source"] for r in rows],
                        "source_size": np.array([r["source_size"] for r in rows], dtype=np.int64)})
    w = np.array([weights[i % len(weights)] for i in range(len(out))])
    out["target"] = targets(out["source_size"].to_numpy(), w, most) if len(out) else np.zeros(0)
    out["blocks"] = -(-out["source_size"] // block)
    ratio = out["target"] / out["source_size"].where(out["source_size"] > 0, 1)
    out["slots"] = np.minimum(np.rint(ratio * out["blocks"]), np.floor(most) * out["blocks"]).astype(np.int64)
    return out


def _fill(drawn: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the slots that sources drew beyond their number go: start of each source's surplus,
    and the ends of the gaps that the surplus fills, in source order."""
    surplus, gap = np.maximum(drawn - slots, 0), np.maximum(slots - drawn, 0)
    return np.cumsum(surplus) - surplus, np.cumsum(gap) - gap, gap


def slots(spark: SparkSession, mix: pd.DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, source_no, slot, block_no): every slot of the mix, numbered within its source, with the block that fills it."""
    want, blocks = mix["slots"].to_numpy(), mix["blocks"].to_numpy()
    total = int(want.sum())
    if total == 0:
        return spark.createDataFrame([], "shard long, source_no int, slot long, block_no long")
    p = want / total
    n_shards = -(-total // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                n = min(shard_slots, total - shard * shard_slots)
                got = np.random.Generator(np.random.Philox(key=[seed, int(shard)])).multinomial(n, p)
                at = np.nonzero(got)[0]
                yield pd.DataFrame({"shard": shard, "source_no": at.astype(np.int32), "n": got[at]})

    counts = spark.range(n_shards).mapInPandas(draw, "shard long, source_no int, n long")
    numbered = running_sum(counts, "source_no", ["shard"], "n", "first")
    drawn = np.zeros(len(mix), np.int64)
    for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect():
        drawn[r["source_no"]] = r["n"]
    surplus_at, gap_at, gap = _fill(drawn, want)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (batch.iloc[lo:lo + 64] for batch in batches for lo in range(0, len(batch), 64)):
            n = pdf["n"].to_numpy()
            src = np.repeat(pdf["source_no"].to_numpy(), n).astype(np.int64)
            k = np.repeat(pdf["first"].to_numpy(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            over = k >= want[src]
            if over.any():
                rank = surplus_at[src[over]] + k[over] - want[src[over]]
                to = np.searchsorted(gap_at + gap, rank, side="right")
                src[over], k[over] = to, drawn[to] + rank - gap_at[to]
            size = blocks[src]
            key = (src * 1_000_003 + k // size + 1) * 0x9E3779B1 + seed
            yield pd.DataFrame({"shard": np.repeat(pdf["shard"].to_numpy(), n), "source_no": src.astype(np.int32), "slot": k,
                                "block_no": permuted(k % size, size, key)})

    tasks = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return numbered.repartition(tasks).mapInPandas(place, "shard long, source_no int, slot long, block_no long")


def _pieces(placed: DataFrame, mix: pd.DataFrame, block: int, *columns: str) -> DataFrame:
    """(source_no, block_no, start, word_from, words, ...): what each document has of each block of its source:
    ``words`` words from its word ``word_from`` on."""
    names = placed.sparkSession.createDataFrame([(i, s) for i, s in enumerate(mix["source"])], "source_no int, _source string")
    numbered = placed.where("size > 0").join(F.broadcast(names), F.col("source").eqNullSafe(F.col("_source")))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = numbered.select("source_no", "start", "size", *columns, F.explode(F.sequence(first, last)).alias("block_no"))
    begin = F.greatest(F.col("start"), F.col("block_no") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)
    return pieces.select("source_no", "block_no", "start", *columns, (begin - F.col("start")).alias("word_from"), (end - begin).alias("words"))


def mix_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS,
               block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED,
               ) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """The mix of ``docs`` (doc_id, text, source).

    Returns the documents with their place (doc_id, source, size, start), the mixed pieces
    (shard, source_no, slot, block_no, start, doc_id, word_from, words: words ``word_from`` and on of the
    document that starts at ``start`` in its source) and the mixture table.

    Null or blank texts have size 0 and are never taken; a null source is one more source, the
    last; rows with null or repeated ids each have their own place; no rows give no rows.
    """
    placed = document_offsets(docs)
    mix = mixture(placed, weights, most, block)
    # the planner cannot know how many slots a count stands for: no broadcast by its estimate
    mixed = slots(docs.sparkSession, mix, shard_slots, seed).join(
        _pieces(placed, mix, block, "doc_id").hint("merge"), ["source_no", "block_no"])
    return placed, mixed, mix


def token_blocks(placed: DataFrame, mix: pd.DataFrame, block: int = BLOCK) -> DataFrame:
    """(source_no, block_no, parts, words): the blocks themselves.  Texts (``document_offsets(..., with_text=True)``)
    are cut into words, and each block gets ``block`` of them in the order of its source's stream; parts tell, in
    order, which document gave how many.  A block gathers at most ``block`` pieces, a source any number of blocks."""
    cut = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("word_from") + 1).cast("int"), F.col("words").cast("int"))
    pieces = _pieces(placed, mix, block, "doc_id", "text").select("source_no", "block_no", F.struct("start", "doc_id", cut.alias("words")).alias("_p"))
    both = pieces.groupBy("source_no", "block_no").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    parts = F.transform("_p", lambda p: F.struct(p["doc_id"].alias("doc_id"), F.size(p["words"]).alias("words")))
    return both.select("source_no", "block_no", parts.alias("parts"), F.flatten("_p.words").alias("words"))


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS, block: int = BLOCK,
                 shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, source, slot, block_no, parts, words), one row for each slot with the block that
    fills it, packed from the texts of ``docs`` (doc_id, text, source).  Texts are shuffled once to their
    places and blocks once to their slots; write the result partitioned by ranges of ``shard``."""
    placed = document_offsets(docs, with_text=True)
    mix = mixture(placed, weights, most, block)
    names = docs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(mix["source"])], "source_no int, source string")
    blocks = materialise(token_blocks(placed, mix, block))
    filled = slots(docs.sparkSession, mix, shard_slots, seed).join(blocks.hint("merge"), ["source_no", "block_no"])
    return filled.join(F.broadcast(names), "source_no").select("shard", "source", "slot", "block_no", "parts", "words")


def mixing_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of the mix, one row for every row of ``docs``."""
    spark = docs.sparkSession
    placed, mixed, mix = mix_blocks(docs)
    taken = mixed.groupBy("source_no", F.col("start").alias("_start")).agg(F.sum("words").alias("_taken"))
    sources = spark.createDataFrame(
        [(i, r.source, int(r.source_size), float(r.target)) for i, r in enumerate(mix.itertuples())],
        "_no int, _source string, source_size long, target double")
    named = placed.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_source")))
    return (named.join(taken, (F.col("_no") == F.col("source_no")) & (F.col("start") == F.col("_start"))
                       & (F.col("size") > 0), "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"), "source"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(table(spark, sf_dir, "documents"))
