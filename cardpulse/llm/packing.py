"""Packing documents into sequences by best-two-fit.

A document's tokens and an end token make pieces of at most ``LENGTH`` tokens.  Only lengths matter
to a packing, so it is planned on the counts of each length, at most ``LENGTH`` numbers however
many pieces there are:

* A sequence is filled greedily: the longest piece left that fits, until none fits.
* Then its shortest piece is given back if two pieces left fill the gap it leaves (the gap before
  and its own length) more tightly; the pair of greatest total that fits takes its place.
* The same choice is made again as long as the counts last, so it is one pattern with a
  multiplicity.  With each pattern some length falls below the number that the pattern uses of
  it, at most LENGTH / length; there are therefore fewer than LENGTH * (ln LENGTH + 1) patterns (about 8,000 for
  1,024 tokens), whatever the input.

A pattern's slots own ranges of the running numbers of the pieces of their length.  Pieces are
numbered within their length over range partitions, and each finds its sequence and offset in the
plan, which is sent to the tasks; pieces never meet in one place.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import materialise, running_sum, table
from cardpulse.llm.words import chunks

LENGTH = 1024
END_TOKEN = 2
# Fixed value: the pattern that parts a text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _token_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizer file ``path``, without added special tokens.

    A plain byte-level vocabulary whose merges are in the order of their ids is run by a faster
    library on the same merges; texts that hold an added token's string, and all other
    tokenizers, by the file's own library.  Both give the same ids.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def slow(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
             and split.get("use_regex", True) and spec.get("normalizer") is None and spec.get("truncation") is None
             and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback"))
    if not plain:
        return slow
    vocabulary, of = model["vocab"], _token_bytes()
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if len(set(joined)) != len(joined) or [vocabulary.get(t) for t in joined] != list(range(256, 256 + len(joined))):
        return slow
    import tiktoken

    added = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if t not in set(added)}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        return slow(text) if any(a in text for a in added) else fast.encode_ordinary(text)

    return ids


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END_TOKEN,
           with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document (null text: empty).

    A document of more than ``length`` tokens is cut; its first piece is what full pieces leave.
    """
    where = path or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id", F.lit(0).alias("piece"), *[F.lit(0).cast("long").alias(c) for c in names[2:5]],
                         *[F.array(F.lit(0)).alias("ids")] * with_ids).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where)
        for part in chunks(batches, most=2 << 20):
            of, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                tokens = np.array([*encode(text or ""), end], "<u4")
                cuts = [0, *range(len(tokens) % length or length, len(tokens), length), len(tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    of.append(i)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    if with_ids:
                        ids.append(tokens[a:b].astype(np.int32))
            columns = [part.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                       *[pa.array(x, pa.int64()) for x in (start, size, crc)]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return rows.mapInArrow(run, schema)


def _greedy(counts: np.ndarray, room: int) -> dict[int, int]:
    """Length -> number in one sequence: the longest that is left and fits, until none fits."""
    used: dict[int, int] = {}
    fits = np.nonzero(counts)[0]
    while True:
        fits = fits[:np.searchsorted(fits, room, side="right")]
        if not len(fits):
            return used
        size = int(fits[-1])
        n = min(int(counts[size]), room // size)
        used[size] = n
        room -= n * size
        fits = fits[:-1]


def _swap(counts: np.ndarray, used: dict[int, int], room: int) -> dict[int, int]:
    """``used`` with its shortest piece replaced by the two pieces left that fill its place best, if any do."""
    if sum(used.values()) < 2:
        return used
    least = min(used)
    gap = room - sum(size * n for size, n in used.items())
    left = counts.copy()
    for size, n in used.items():
        left[size] -= n
    have = np.nonzero(left)[0]
    first = have[have < gap + least]
    if not len(first):
        return used
    at = np.searchsorted(have, np.minimum(gap + least - first, first), side="right") - 1
    ok = at >= 0
    second = np.where(ok, have[np.maximum(at, 0)], 0)
    twice = ok & (second == first) & (left[first] < 2)          # the only piece of its length: the next shorter
    second = np.where(twice, np.where(at > 0, have[np.maximum(at - 1, 0)], 0), second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    if total[best] <= least:
        return used
    out = dict(used)
    out[least] -= 1
    for size in (int(first[best]), int(second[best])):
        out[size] = out.get(size, 0) + 1
    return {size: n for size, n in out.items() if n}


def plan(counts: np.ndarray, room: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, copies in a sequence, multiplicity, first sequence, offset) of the slots of all patterns.

    ``counts[k]`` pieces have k tokens.  The pieces of a slot are those of its length whose numbers
    are in [first, first + copies * multiplicity).
    """
    counts = np.array(counts, np.int64)
    next_of = np.zeros(len(counts), np.int64)
    out, sequence = [], 0
    while counts.any():
        used = _swap(counts, _greedy(counts, room), room)
        times = min(int(counts[size]) // n for size, n in used.items())
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            out.append((size, int(next_of[size]), n, times, sequence, offset))
            next_of[size] += n * times
            counts[size] -= n * times
            offset += n * size
        sequence += times
    return out


def placed(found: DataFrame, room: int = LENGTH) -> DataFrame:
    """``found`` (doc_id, piece, length, ...; a written table) with ``sequence_id`` and ``offset``."""
    counts = np.zeros(room + 1, np.int64)
    for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():   # at most one row per length
        counts[r["length"]] = r["n"]
    slots = sorted(plan(counts, room))
    shared = found.sparkSession.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 6))
    numbered = running_sum(found.withColumns({"_one": F.lit(1).cast("long"), "_no_id": F.col("doc_id").isNull()}),
                           "length", ["_no_id", "doc_id", "piece"], "_one", "_number").drop("_one", "_no_id")
    schema = numbered.drop("_number").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        first = np.searchsorted(slot[:, 0], np.arange(room + 2)) if len(slot) else np.zeros(room + 2, np.int64)
        for batch in batches:
            size, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            at = np.empty(len(size), np.int64)
            for k in np.unique(size):
                here = size == k
                at[here] = first[k] + np.searchsorted(slot[first[k]:first[k + 1], 1], number[here], side="right") - 1
            inside = number - slot[at, 1]
            times = slot[at, 3]
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "_number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[at, 4] + inside % times),
                                              pa.array(slot[at, 5] + inside // times * size)], schema.names)

    return numbered.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END_TOKEN,
         with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row for every piece of ``docs``.

    Null and empty texts are one piece of the end token alone; rows with null or repeated ids
    and repeated rows each have their own pieces; no rows give no rows; other columns are not read.
    """
    return placed(materialise(pieces(docs, path, length, end, with_ids)), length)


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END_TOKEN) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, each of at most ``length`` tokens."""
    whole = pack(docs, path, length, end, with_ids=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))   # at most ``length`` pieces
    return (whole.groupBy("sequence_id").agg(parts.alias("_parts"))
            .select("sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.doc_id").alias("doc_ids")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
