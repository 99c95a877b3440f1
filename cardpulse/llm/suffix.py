"""Repeated byte strings by anchored windows and hash classes, in place of a radix sort of suffixes.

A window is ``LENGTH`` bytes of a text.  Sorting suffixes digit by digit would begin with a row for
every byte of the corpus (8 bytes of digit for each byte of text, many times what a run may write to
disk), so no suffix is ordered here; the windows that such a sort would leave in groups of
several are found through fewer rows:

1. Every window has an anchor, the position in it whose ``GRAM`` bytes have the least hash (the
   first of equals).  It depends on the window's bytes only, so equal windows have their anchors at
   the same offset with the same gram.  Neighbouring windows mostly share their anchor, so a document
   sends about 2 / (LENGTH - GRAM) rows a byte, each with its range of offsets.
2. Anchors of a gram are classed by the hash of all bytes under their windows.  Anchors equal in it are
   one class: all their windows are repeated.
3. Where a gram has several classes, they are aligned at the anchor, and windows at the same offset are
   compared by the hash of their bytes, many grams at a time in a task.  A gram with more than
   ``HOT_CLASSES`` classes is split first: the offsets are cut into cells, and the classes are formed once
   more in each cell, for the bytes that all its windows share and for all bytes under them; in the last
   pass a cell is one window.  So no group meets in one task, whatever its size.

Repeated windows come back as ranges of offsets, are laid over their documents, and the bytes
they cover are removed.  Windows are equal up to collisions of 64-bit hashes within a gram's anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import materialise, slices, table, utf8_rows
from cardpulse.llm.words import chunks

LENGTH = 400
GRAM = 32
HOT_CLASSES = 256          # classes of a gram that are compared in one task
BATCH_CLASSES = 1024       # classes compared together, of one or many grams
CELLS = (24, 1)            # offsets that a hot gram is split into, one pass after another
PIECE = 512 << 10          # bytes of text looked at together; anchors take up to some 60 bytes for each
MERGED_KEYS = 1024         # keys whose stretches are merged together
SEED = 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) bytes from every position on; each doubling joins two halves."""
    h = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)[data]
    width = 1
    while width < gram:
        h = _mix(h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
        width *= 2
    return h


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours: block minima from the left and from the right."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, gram hash) of every anchor in ``data``, documents laid end to
    end from ``starts`` on (the end included); windows do not leave their document."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, np.empty(0, np.uint64)
    h = gram_hashes(data, gram)
    place = np.uint64(23)
    packed = ((h >> place) << place) | np.arange(len(h), dtype=np.uint64)
    least = _least(packed, length - gram + 1)
    at = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
    size = np.diff(starts)
    room = np.maximum(size - length + 1, 0)
    windows = np.arange(room.sum()) + np.repeat(starts[:-1] - (np.cumsum(room) - room), room)
    if not len(windows):
        return none, none, none, np.empty(0, np.uint64)
    at = at[windows]
    new = np.nonzero((at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))[0] + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(windows)]]) - 1
    return at[first], windows[first], windows[last], h[at[first]]


def _pieces(texts: list[bytes | None], length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, rows, offsets): documents laid end to end to about ``most`` bytes; a longer document is
    cut so that neighbouring pieces share all windows' bytes but no window."""
    parts: list[bytes] = []
    rows: list[int] = []
    offsets: list[int] = []
    held = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.frombuffer(b"".join(parts), np.uint8), starts, np.array(rows), np.array(offsets)

    for i, text in enumerate(texts):
        text = text or b""
        if len(text) < length:
            continue
        for lo in range(0, len(text) - length + 1, most):
            part = text[lo:lo + most + length - 1]
            if held and held + len(part) > most:
                yield out()
                parts, rows, offsets, held = [], [], [], 0
            parts.append(part)
            rows.append(i)
            offsets.append(lo)
            held += len(part)
    if parts:
        yield out()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("text"))


def anchor_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _hash, pos, near, far, gram, cls): every anchor of every row; its windows begin ``near`` to ``far``
    bytes before it, and cls is the hash of their bytes and offsets."""
    rows, most = _keyed(docs.where("text is not null")), PIECE
    schema = rows.select("_id", "_hash", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("near"), F.lit(0).alias("far"),
                         F.lit(0).cast("long").alias("gram"), F.lit(b"").alias("cls")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in chunks(batches, "text", most):
            for data, starts, at, offsets in _pieces(utf8_rows(batch.column(2)), length, most):
                pos, first, last, gram = anchors(data, starts, length)
                if not len(pos):
                    continue
                raw, near, far = data.tobytes(), (pos - last).astype(np.int32), (pos - first).astype(np.int32)
                cls = [blake2b(raw[a:b + length] + n.to_bytes(4, "little"), digest_size=16).digest()
                       for a, b, n in zip(first.tolist(), last.tolist(), near.tolist())]
                k = np.searchsorted(starts, first, side="right") - 1
                where = pa.array(at[k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), pa.array(pos - starts[k] + offsets[k]),
                     pa.array(near), pa.array(far), pa.array(gram.view(np.int64)), pa.array(cls, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (_id, _hash, pos, near, far, gram, cls, n) with ``bytes``, all bytes under the anchor's windows."""
    per = (wanted.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h"))
           .agg(F.collect_list(F.struct("pos", "near", "far", "gram", "cls", "n")).alias("at")).hint("merge"))
    both = _keyed(docs).join(per, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).dropDuplicates(["_id", "_hash"])
    most = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # anchors stay in arrays; only their bytes are Python objects, a few thousand at a time
        for batch in chunks(batches, "text", most):
            texts, lists = utf8_rows(batch.column(0)), batch.column(1)
            row, at = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten()
            for lo in range(0, len(at), 4096):
                pos, near, far, gram, cls, n = at.slice(lo, 4096).flatten()
                first, last = pos.to_numpy() - far.to_numpy(), pos.to_numpy() - near.to_numpy()
                raw = [texts[i][a:b + length] for i, a, b in zip(row[lo:lo + 4096].tolist(), first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([gram, cls, near, far, n, pa.array(raw, pa.binary())], ["gram", "cls", "near", "far", "n", "bytes"])

    return both.select("text", "at").mapInArrow(run, "gram long, cls binary, near int, far int, n long, bytes binary")


def _window_hashes(near: np.ndarray, far: np.ndarray, raw: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, offset, hash) of every window of every class.  Classes are laid side by side, aligned at the
    anchor; each column has its own random factor, and a window's hash is a difference of running sums."""
    reach = length - gram
    width = reach + length
    factor = np.random.default_rng(SEED + 1).integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)
    letter = np.random.default_rng(SEED + 2).integers(1, 1 << 63, 256, dtype=np.uint64)
    aligned = np.zeros((len(raw), width), np.uint8)
    for i, b in enumerate(raw):
        lo = reach - far[i]
        aligned[i, lo:lo + len(b)] = np.frombuffer(b, np.uint8)
    total = np.zeros((len(raw), width + 1), np.uint64)
    np.cumsum(_mix(letter[aligned] * factor), axis=1, out=total[:, 1:])
    n = far - near + 1
    cls = np.repeat(np.arange(len(raw)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(near, n)
    return cls, offset, total[cls, reach - offset + length] - total[cls, reach - offset]


def _ranges(cls: np.ndarray, offset: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, first, last) of the maximal ranges of hit offsets; rows are in order of class and offset."""
    c, d = cls[hit], offset[hit]
    if not len(c):
        return c, d, d
    new = np.nonzero((c[1:] != c[:-1]) | (d[1:] != d[:-1] + 1))[0] + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(c)]]) - 1
    return c[first], d[first], d[last]


def _compare(gram: np.ndarray, near: np.ndarray, far: np.ndarray, n: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Ranges of repeated windows of the classes of whole grams: a window is repeated if its class has
    several anchors or another class of the gram has an equal window at the offset."""
    cls, offset, h = _window_hashes(near, far, raw, length, GRAM)
    key = _mix(h + _mix(gram.view(np.uint64)[cls]) * np.uint64(2 * LENGTH + 1) + offset.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return _ranges(cls, offset, hit | (n[cls] > 1))


def _few(classes: DataFrame, length: int) -> DataFrame:
    """(gram, cls, first, last): repeated windows of grams of few classes, whole grams compared in a task."""
    ordered = classes.repartition("gram").sortWithinPartitions("gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            near, far, n = (t.column(k).to_numpy().astype(np.int64) for k in ("near", "far", "n"))
            c, first, last = _compare(t.column("gram").to_numpy(), near, far, n, t.column("bytes").to_pylist(), length)
            where = pa.array(c)
            return pa.RecordBatch.from_arrays(
                [t.column("gram").take(where).combine_chunks(), t.column("cls").take(where).combine_chunks(),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["gram", "cls", "first", "last"])

        rows = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held.append(batch.slice(lo, 256))
                rows += held[-1].num_rows
                if rows >= BATCH_CLASSES:
                    t = pa.Table.from_batches(held)
                    g = t.column("gram").to_numpy()
                    whole = int(np.searchsorted(g, g[-1], side="left"))
                    if whole:
                        yield done(t.slice(0, whole))
                        t = t.slice(whole)
                    held, rows = t.to_batches(), t.num_rows
        if rows:
            yield done(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "gram long, cls binary, first int, last int")


def _split(classes: DataFrame, length: int, width: int) -> DataFrame:
    """(gram, cls, key, sub, near, far, n, bytes): the classes' offsets cut into cells of ``width`` offsets, one
    row each.  ``key`` is the gram, the cell and the bytes that all windows of the cell share, ``sub`` all
    bytes under the class's own windows there: the first and second digit once more, for a shorter range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        names = ["gram", "cls", "key", "sub", "near", "far", "n", "bytes"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

        def part(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            out: list[tuple] = []
            for gram, cls, near, far, n, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for cell in range(near // width, far // width + 1):
                    lo, hi = cell * width, cell * width + width - 1
                    a, b = max(near, lo), min(far, hi)
                    common = raw[far - lo:max(far - lo, far + length - hi)]
                    own = raw[far - b:far + length - a]
                    key = blake2b(gram.to_bytes(8, "little", signed=True) + cell.to_bytes(4, "little") + common, digest_size=8).digest()
                    sub = blake2b(a.to_bytes(4, "little") + b.to_bytes(4, "little") + own, digest_size=16).digest()
                    out.append((gram, cls, int.from_bytes(key, "little", signed=True), sub, a, b, n, own))
                if len(out) >= 4096:
                    yield part(out)
                    out = []
            if out:
                yield part(out)

    return classes.mapInArrow(run, "gram long, cls binary, key long, sub binary, near int, far int, n long, bytes binary")


def _found(classes: DataFrame, length: int, hot_classes: int, cells: tuple[int, ...]) -> DataFrame:
    """(gram, cls, first, last): the repeated windows of classes (gram, cls, near, far, n, bytes) of grams that
    have several."""
    hot = materialise(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot_classes)
                      .select(F.col("gram").alias("_gram")))
    if not cells or hot.isEmpty():
        return _few(classes, length)
    few = _few(classes.join(hot, F.col("gram") == F.col("_gram"), "left_anti"), length)
    parts = materialise(_split(classes.join(hot, F.col("gram") == F.col("_gram"), "left_semi"), length, cells[0]))
    subs = materialise(parts.groupBy("key", "sub").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("near", "far", "bytes")]))
    keys = materialise(subs.groupBy("key").agg(F.count(F.lit(1)).alias("_c"), F.sum("n").alias("_n")).where("_n > 1")
                       .withColumnRenamed("key", "_key"))
    left = materialise(subs.join(keys, F.col("key") == F.col("_key")))
    alone = left.where("_c = 1").select("key", "sub", F.col("near").alias("first"), F.col("far").alias("last"))
    several = left.where("_c > 1").select(F.col("key").alias("gram"), F.col("sub").alias("cls"), "near", "far", "n", "bytes")
    below = materialise(alone.union(_found(several, length, hot_classes, cells[1:]))).toDF("_key", "_sub", "first", "last")
    up = parts.select("gram", "cls", "key", "sub").join(below, (F.col("key") == F.col("_key")) & (F.col("sub") == F.col("_sub")))
    return few.union(up.select("gram", "cls", "first", "last"))


def repeated(docs: DataFrame, length: int = LENGTH, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(_id, _hash, spans): per document the byte stretches (from, to) under windows that occur anywhere else,
    in order and apart from each other."""
    rows = materialise(anchor_table(docs, length))
    classes = materialise(rows.groupBy("gram", "cls").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("_id", "_hash", "pos", "near", "far")]))
    grams = materialise(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("total"))
                        .where("total > 1").select(F.col("gram").alias("_gram"), "classes"))
    shared = materialise(classes.join(grams, F.col("gram") == F.col("_gram")).drop("_gram"))
    alone = shared.where("classes = 1").select("gram", "cls", F.col("near").alias("first"), F.col("far").alias("last"))
    wanted = shared.where("classes > 1").select("_id", "_hash", "pos", "near", "far", "gram", "cls", "n", "classes")
    bytes_of = materialise(_contexts(docs, wanted, length))
    found = alone.union(_found(bytes_of, length, hot_classes, CELLS))
    ranges = materialise(_merged(found.select("gram", "cls", F.col("first").alias("a"), (F.col("last") + 1).alias("b")), ["gram", "cls"])
                         .select(F.col("gram").alias("_g"), F.col("cls").alias("_c"), "spans"))
    hits = (rows.select("_id", "_hash", "pos", "gram", "cls")
            .join(ranges, (F.col("gram") == F.col("_g")) & (F.col("cls") == F.col("_c"))))
    spans = hits.select("_id", "_hash", "pos", F.explode("spans").alias("s")).select(
        "_id", "_hash", (F.col("pos") - F.col("s.b") + 1).alias("a"), (F.col("pos") - F.col("s.a") + length).alias("b"))
    return _merged(spans, ["_id", "_hash"])


def merged_stretches(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b): stretches in order of key and a, overlapping and touching ones of a key made one."""
    if not len(key):
        return key, a, b
    lo = key * (b.max() - a.min() + 2)          # stretches of different keys never touch
    reach = np.maximum.accumulate(b + lo)
    new = np.concatenate([[0], np.nonzero((a + lo)[1:] > reach[:-1])[0] + 1])
    end = np.concatenate([new[1:], [len(key)]]) - 1
    return key[new], a[new], (reach - lo)[end]


def _merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key its stretches (a, b) in order, overlapping and touching ones made one."""
    listed = spans.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a class may have a stretch for every window, so they stay in arrays, a few keys at a time
        for batch in slices(batches, MERGED_KEYS):
            kind = batch.schema.field(2).type
            lists = batch.column(2)
            a, b = (lists.flatten().field(i).to_numpy() for i in range(2))
            key, first, last = merged_stretches(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), a, b)
            edges = np.searchsorted(key, np.arange(len(lists) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(first), pa.array(last)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edges), items, type=kind)],
                                             batch.schema.names)

    return listed.mapInArrow(run, listed.schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row for every row of ``docs`` (doc_id, text); kept holds
    the remaining bytes.

    A null text is empty; rows with equal id and text are separate documents, so each repeats the
    other; null ids are kept; texts shorter than ``length`` lose nothing; no rows give no rows.
    """
    spans = materialise(repeated(docs, length, hot_classes)).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "spans").hint("merge")
    both = (_keyed(docs).join(spans, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
            .select(F.col("_id").alias("doc_id"), "text", "spans"))
    schema = both.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit(b"").alias("kept")).schema
    most = PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", most):
            size, removed, n, kept = [], [], [], []
            for text, gone in zip(utf8_rows(batch.column(1)), batch.column(2).to_pylist()):
                text, gone = text or b"", gone or []
                edges = [0, *[e for s in gone for e in (s["a"], s["b"])], len(text)]
                rest = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
                size.append(len(text)), removed.append(len(text) - len(rest)), n.append(len(gone)), kept.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (size, removed, n)], pa.array(kept, pa.binary())],
                                             schema.names)

    return both.mapInArrow(run, schema)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Every window of every document by its hash; bytes as two hexadecimal digits.
OP3_SQL = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select rid, h, unnest(range(0, greatest(len(h) // 2 - 399, 0))) as i from d),
rep as (select rid, i from (select rid, i, hash(substr(h, 2 * i + 1, 800)) as k from w) qualify count(*) over (partition by k) > 1),
marked as (select rid, i, case when i <= lag(i) over (partition by rid order by i) + 400 then 0 else 1 end as fresh from rep),
island as (select rid, i, sum(fresh) over (partition by rid order by i) as k from marked),
span as (select rid, k, min(i) as a, max(i) + 400 as b from island group by 1, 2),
gap as (select s.rid, s.a, s.b, substr(d.h, 2 * lag(s.b, 1, 0) over (partition by s.rid order by s.a) + 1,
               2 * (s.a - lag(s.b, 1, 0) over (partition by s.rid order by s.a))) as before, d.h
        from span s join d using (rid)),
per as (select rid, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans,
               string_agg(before, '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept from gap group by 1)
select doc_id, len(d.h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, d.h))) as kept_sha256
from d left join per using (rid)
"""
