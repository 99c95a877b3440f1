"""Phrase collocations by Toivonen's mining: a sample proposes, a full pass decides.

Phrases are runs of 1 to ``MOST_WORDS`` words inside a piece of a text, counted per language.  A
phrase is frequent if it occurs ``LEAST`` times; every part of a frequent phrase is frequent.

1. A hash of the id picks a share of the documents.  Phrases shorter than ``MOST_WORDS`` that are
   frequent there, at a threshold lowered by one standard deviation, are proposed.
2. The full pass counts the proposed phrases and their negative border: all other words, and all
   other phrases whose two parts of one word less are proposed.  The border is far larger than
   what is proposed and mostly rare, so its phrases are added up by 64-bit hashes, which can only
   overstate a count.
3. Border phrases that reach the threshold are failures.  If there are any, an expansion pass counts
   them by their words, and with them all phrases not yet counted none of whose parts is known to be
   infrequent.  What it leaves out has an infrequent part, so the set is closed after it.

The counts of all frequent phrases come from their words, never from hashes, and are exact whatever
the sample was.  Sets of phrases go to the tasks as bit tables of a fixed size; a false bit only makes
a pass count a phrase too many, exactly.  What tasks send on are counts of distinct phrases of a
chunk of texts: strings as rows, hashes as packed runs of a range of hashes.  Scores, cuts and
cover tests are joins and aggregates of the frequent phrases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.llm.common import materialise, table
from cardpulse.llm.decontaminate import bit_table, passes
from cardpulse.llm.words import Words, byte_classes, chunks, distinct, phrases, split

MOST_WORDS = 4
LEAST = 30
SAMPLE_SHARE = 4         # one document in so many proposes
FILTER_BITS = 26
SCALE = 2_000_000
COVER_PERCENT = 80
REPORT = 2_000           # phrases of each language in the report
UNKNOWN = "und"
PIECES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
CHUNK = 6 << 20          # bytes of text whose phrases are counted together
ROWS_OUT = 1 << 16
PAIRS_HELD = 4 << 20     # counts that a task holds before it adds up


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import xxhash

    seed, digest = xxhash.xxh32_intdigest(lang), xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of all but its last word and of its last word."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + last
    return h ^ (h >> np.uint64(32))


def _hashed(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the phrases of ``n`` words from every place on, given those of single words."""
    out = h[:max(0, len(h) - n + 1)]
    for k in range(1, n):
        out = _longer(out, h[k:len(h) - n + 1 + k])
    return out


def _inside(words: Words, n: int) -> np.ndarray:
    """Whether the ``n`` words from a place on lie in one piece."""
    m = max(0, len(words.codes) - n + 1)
    return words.piece[:m] == words.piece[n - 1:n - 1 + m]


def _by_language(part: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    langs = part.column(0).dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        words = split(part.column(1).take(pa.array(np.nonzero(codes == k)[0])), PIECES)
        if len(words.codes):
            yield lang, words


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def _pairs(h: np.ndarray, ranges: int) -> pa.RecordBatch:
    """The different hashes of ``h`` with their numbers, one row for each of ``ranges`` ranges of hashes."""
    value, count = np.unique(h, return_counts=True)
    cuts = np.searchsorted(value, np.array([(k << 64) // ranges for k in range(ranges)], np.uint64))
    rows = [(k, value[a:b].tobytes() + count[a:b].astype("<i8").tobytes())
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(value)])) if a < b]
    return _batch([k for k, _ in rows], pairs=[x for _, x in rows])


def _batch(ranges: list | np.ndarray, pairs: list | None = None, lang: str | None = None, n: int | None = None,
           phrase: pa.Array | None = None, count: np.ndarray | None = None) -> pa.RecordBatch:
    size = len(ranges)
    one = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(size, np.int64)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ranges, pa.int32()), one(lang, pa.string()), one(n, pa.int32()),
         one(None, pa.string()) if phrase is None else phrase.cast(pa.string()),
         one(None, pa.int64()) if count is None else pa.array(count.astype(np.int64)),
         one(None, pa.binary()) if pairs is None else pa.array(pairs, pa.binary())], ["part", "lang", "n", "phrase", "c", "pairs"])


SENT = "part int, lang string, n int, phrase string, c long, pairs binary"
FOUND = "lang string, n int, phrase string, f long, h long"


def _added(held: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of (hash, number) as one, equal hashes added."""
    if len(held) < 2:
        return held
    rows = np.concatenate(held, axis=1)
    order = np.argsort(rows[0])
    h = rows[0][order]
    first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
    return [np.stack([h[first], np.add.reduceat(rows[1][order], first)])]


def _summed(sent: DataFrame, least: int) -> DataFrame:
    """(lang, n, phrase, f, h): phrases, or hashes with a null phrase, that add up to ``least``, and all rows of n = 0.

    A part gets the phrases and hashes of its range; each chunk has sent any of them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size, most = [], [], 0, PAIRS_HELD
        for batch in batches:
            for blob in batch.column(5).drop_null().to_pylist():
                held.append(np.frombuffer(blob, np.int64).reshape(2, -1))
                size += held[-1].shape[1]
                if size > PAIRS_HELD and len(held) > 1:
                    held = _added(held)
                    size = held[0].shape[1] // 2         # again after as many new ones, so the work stays near linear
            table = pa.Table.from_batches([batch]).select(["lang", "n", "phrase", "c"])
            words.append(table.filter(table["phrase"].is_valid()))
            if sum(len(t) for t in words) > most:
                words = [_grouped(words)]
                most = max(PAIRS_HELD, 2 * len(words[0]))
        table = _grouped(words) if words else None
        if table is not None and len(table):
            for part in table.filter(pc.or_(pc.greater_equal(table["c"], least), pc.equal(table["n"], 0))).to_batches(ROWS_OUT):
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, none], ["lang", "n", "phrase", "f", "h"])
        for h, count in _added(held):
            h, count = h[count >= least], count[count >= least]
            none = [pa.nulls(len(h), t) for t in (pa.string(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(count), pa.array(h)], ["lang", "n", "phrase", "f", "h"])

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "part").mapInArrow(run, FOUND)


def _grouped(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "n", "phrase"]).aggregate([("c", "sum")])
    return out.rename_columns({"c_sum": "c"}).select(["lang", "n", "phrase", "c"])


def proposed(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, share: int = SAMPLE_SHARE) -> bytes:
    """Bit table of the phrases of fewer than ``most_words`` words that one document in ``share`` proposes."""
    expected = least / share
    lowered = max(1, math.floor(expected - math.sqrt(expected)))
    ranges = _ranges(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most=CHUNK):
            found = []
            for lang, words in _by_language(part):
                h = word_hashes(words.vocabulary.to_pylist(), lang)[words.codes]
                found += [_hashed(h, n)[_inside(words, n)] for n in range(1, most_words)]
            if found:
                yield _pairs(np.concatenate(found), ranges)

    sample = _rows(docs.where(F.pmod(F.xxhash64("doc_id", F.lit("phrases")), F.lit(share)) == 0))
    return bit_table(_summed(sample.mapInArrow(run, SENT), lowered), "h", FILTER_BITS)


def _ranges(docs: DataFrame) -> int:
    """Number of parts that phrases and hashes are dealt to, a few for each task that adds them up."""
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _places(words: Words, h: np.ndarray, sample: np.ndarray, known: np.ndarray | None, failed: np.ndarray | None,
            most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(n, places, None) of phrases that a pass counts by their words, and (n, places, hashes) of the border.

    In the full pass (``known`` None) those are the proposed phrases and the border; in the
    expansion pass, the failures and what has not been counted and has no infrequent part."""
    def has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
        return passes(bits, values.view(np.int64), FILTER_BITS)

    counted, grams = np.ones(len(h), bool), h        # by the full pass; hashes of the n words from each place on
    alive = None if known is None else counted
    for n in range(1, most_words + 1):
        if n > 1:
            inside = _inside(words, n)
            if not len(inside):
                return
            counted = counted & has(sample, grams)
            counted = counted[:-1] & counted[1:] & inside
            grams = _longer(grams[:-1], h[n - 1:])
            if alive is not None:
                alive = alive[:-1] & alive[1:] & inside
        at = np.nonzero(counted)[0]
        by_word = has(sample, grams[at]) if n < most_words else np.zeros(len(at), bool)
        if alive is None:
            yield n, at[by_word], None
            yield n, at[~by_word], grams[at[~by_word]]
            continue
        border = at[~by_word]
        again = np.zeros(len(counted), bool)
        again[border[has(failed, grams[border])]] = True
        again |= alive & ~counted
        yield n, np.nonzero(again)[0], None
        alive = alive.copy()
        alive[at] &= has(known, grams[at])


def count_phrases(docs: DataFrame, sample: bytes, known: bytes | None, failed: bytes | None, least: int, most_words: int) -> DataFrame:
    """A pass over all texts: (lang, n, phrase, f, h) of the phrases that it counts and that occur ``least``
    times; in the full pass also the hashes of the border that reach ``least`` (phrase null) and
    the number of words of each language (n = 0, phrase empty)."""
    context = docs.sparkSession.sparkContext
    tables = [None if t is None else context.broadcast(t) for t in (sample, known, failed)]   # of fixed size
    ranges = _ranges(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        bits = [None if t is None else np.frombuffer(t.value, np.uint8) for t in tables]
        for part in chunks(batches, most=CHUNK):
            border = []
            for lang, words in _by_language(part):
                h = word_hashes(words.vocabulary.to_pylist(), lang)[words.codes]
                if bits[1] is None:
                    yield _batch([zlib.crc32(lang.encode()) % ranges], lang=lang, n=0, phrase=pa.array([""]), count=np.array([len(h)]))
                for n, at, hashes in _places(words, h, *bits, most_words):
                    if hashes is not None:
                        border.append(hashes)
                        continue
                    _, where, count = distinct(words, at, n)
                    spread = _hashed_at(h, where, n) % np.uint64(ranges)
                    for lo in range(0, len(where), ROWS_OUT):
                        cut = slice(lo, lo + ROWS_OUT)
                        yield _batch(spread[cut].astype(np.int32), lang=lang, n=n, phrase=phrases(words, where[cut], n), count=count[cut])
            if border:
                yield _pairs(np.concatenate(border), ranges)

    return _summed(_rows(docs).mapInArrow(run, SENT), least)


def _hashed_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = h[at]
    for k in range(1, n):
        out = _longer(out, h[at + k])
    return out


def _phrase_hashes(found: DataFrame) -> DataFrame:
    """(h) of phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            h = np.array([_hashed(w := word_hashes(t.split(b" "), lang), len(w))[0] for lang, t in zip(langs, texts)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return found.select("lang", "phrase").mapInArrow(run, "h long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS,
                     share: int = SAMPLE_SHARE, report: dict | None = None) -> DataFrame:
    """(lang, n, phrase, f): every phrase of 1 to ``most_words`` words with f >= ``least``, and a row
    (lang, 0, '', number of words) of each language.  ``report``, if given, gets the number of failures."""
    columns = ["lang", "n", "phrase", "f"]
    sample = proposed(docs, least, most_words, share)
    first = materialise(count_phrases(docs, sample, None, None, least, most_words))
    exact, border = first.where("phrase IS NOT NULL").select(*columns), first.where("phrase IS NULL").select("h")
    failures = border.count()
    if report is not None:
        report["failures"] = failures
    if not failures:
        return exact
    inner = _phrase_hashes(exact.where((F.col("n") > 0) & (F.col("n") < most_words)))
    known, failed = bit_table(inner.union(border), "h", FILTER_BITS), bit_table(border, "h", FILTER_BITS)
    return exact.union(materialise(count_phrases(docs, sample, known, failed, least, most_words).select(*columns)))


def scored(found: DataFrame, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the frequent phrases ``found`` of two words and more that no
    longer one covers; l and r belong to the cut of least score, the earliest of equals."""
    words = F.split("phrase", " ")
    whole = found.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"), words.alias("w"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("n")), " ").alias("right"))
    parts = found.where("n >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = (cuts.join(parts, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part")))
                .withColumn(name, F.col("f")).drop("_lang", "_part", "f", side))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")]
    # decimals of 38 digits: the product may pass 64 bits; both are whole, so floor is exact integral division
    cuts = cuts.withColumn("score", F.expr(f"CAST(CAST(a AS DECIMAL(28,0)) * CAST({SCALE} AS DECIMAL(10,0)) AS DECIMAL(38,0)) "
                                           "div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    n = F.size(words)
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), n - 1), " "), F.array_join(F.slice(words, F.lit(2), n - 1), " ")))
    # a longer phrase's f is at most that of the phrase one word longer inside it, so that one decides
    covers = (found.where("n >= 3").select(F.col("lang").alias("_lang"), inner.alias("_part"), "f")
              .groupBy("_lang", "_part").agg(F.max("f").alias("longer")))
    kept = best.join(covers, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")), "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < wide[0] * cover_percent))
    return kept.select("lang", "phrase", "a", "b.l", "b.r", F.col("b.score").cast("long").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = REPORT,
                 share: int = SAMPLE_SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by falling score, falling
    a, rising phrase.

    Null texts are empty; a null lang is ``und``, as are rows of that lang; rows with null or
    repeated ids and repeated rows all count; texts without words and empty tables give nothing;
    other columns are not read.
    """
    found = frequent_phrases(docs, least, most_words, share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # a language is first ranked in 64 parts, so that its last ranking takes a bounded number of rows
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored(found).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
    best = (first.where(F.col("_rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top))
    sizes = found.where("n = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return (best.join(sizes, F.col("lang") == F.col("_lang"))
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, [v for v in regexp_split_to_array(piece, '[\x20\x09]+') if v <> ''] as ws from p),
g as (select lang, r.n as size, unnest([array_to_string(ws[i:i + r.n - 1], ' ') for i in range(1, len(ws) - r.n + 2)]) as phrase
      from w, (values (1), (2), (3), (4)) r(n) where len(ws) >= r.n),
f as (select lang, size, phrase, count(*) as f from g group by all),
whole as (select *, string_split(phrase, ' ') as ws from f where size >= 2 and f >= 30),
cuts as (
  select c.lang, c.phrase, c.f as a, k.k, l.f as l, r.f as r, (cast(2000000 as hugeint) * c.f) // (cast(l.f as hugeint) + r.f) as score
  from whole c, (values (1), (2), (3)) k(k)
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:k.k], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[k.k + 1:], ' ')
  where k.k < c.size),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select * from best b where not exists (
    select 1 from whole x where x.lang = b.lang and length(x.phrase) > length(b.phrase)
      and contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') and 100 * x.f >= 80 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, (select cast(sum(f.f) as bigint) from f where f.lang = ranked.lang and f.size = 1) as n,
       cast(score as bigint) as score
from ranked where rank <= 2000
"""
