"""Repeated runs of lines, by a suffix array over line ids (DataFrame operations only).

Every line gets a place in the order of documents (id, null last; then text hash) and lines; the
suffix at a place is the sequence of lines from there to the end of its document.  Prefix doubling
ranks suffixes by their first 1, 2, 4 ... lines: the rank of a suffix in a round is the first place
whose suffix begins with the same lines, so equal ranks are exactly the intervals whose longest
common prefix is at least that long, and sorting by the ranks of all rounds lays the suffixes out
as a suffix array (siblings in order of first appearance).  Suffixes alone in their interval leave
the rounds.

A run is a sequence of lines of one document with at least ``MIN_WORDS`` words.  A line is deleted
if it lies in a run that begins at an earlier place as well, so each maximal repeated run keeps its
first copy and loses the later ones.  It is enough to test, from every line on and up to every
line, the shortest run: any longer repeated run is a union of such runs.  A run of n lines is
identified by the ranks of its first and its last 2^k lines, 2^k <= n < 2^(k+1).

Rows that move are line ids and ranks; texts are read once to hash their lines and once more to
cut them.  A frequent line is one aggregated row before it meets its places in a join that
adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cardpulse.llm.common import checkpointed, materialise, table

MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"


def _document_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.col("doc_id")).withColumn("_hash", F.xxhash64("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(place, _id, _hash, pos, n, h1, h2, before, through): every line of every distinct row, places in order;
    before and through count the document's words before the line and up to its end."""
    rows = _document_key(docs.where("text is not null")).select("_id", "_hash", F.split("text", "\n", -1).alias("lines"))
    lines = rows.select("_id", "_hash", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    hashed = lines.select("_id", "_hash", "pos", "n", F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"),
                          F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("#"), "line")).alias("h2"))
    order = [F.col("_id").isNull(), F.col("_id"), F.col("_hash")]
    ranged = (hashed.dropDuplicates(["_id", "_hash", "pos"])
              .repartitionByRange(*order).sortWithinPartitions(*order, "pos"))
    placed = materialise(ranged.withColumn("place", F.monotonically_increasing_id()))
    doc = Window.partitionBy("_id", "_hash").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    through = F.sum("words").over(doc)
    return materialise(placed.withColumn("through", through).withColumn("before", F.col("through") - F.col("words")).drop("words"))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(place, lines_in_run, _id, _hash, pos): the shortest runs of ``min_words`` words from each line on and up
    to each line."""
    doc = Window.partitionBy("_id", "_hash")
    ahead = doc.orderBy("before").rangeBetween(Window.currentRow, min_words - 1)
    behind = doc.orderBy("through").rangeBetween(-(min_words - 1), Window.currentRow)
    last, total = F.max("pos").over(ahead), F.max("through").over(ahead)
    first, start = F.min("pos").over(behind), F.min("before").over(behind)
    spans = lines.select("place", "_id", "_hash", "pos", "before", "through", last.alias("last"), total.alias("total"),
                         first.alias("first"), start.alias("start"))
    onward = spans.where(F.col("total") - F.col("before") >= min_words).select(
        "place", (F.col("last") - F.col("pos") + 1).alias("run"), "_id", "_hash", "pos")
    upto = spans.where(F.col("through") - F.col("start") >= min_words).select(
        (F.col("place") - F.col("pos") + F.col("first")).alias("place"), (F.col("pos") - F.col("first") + 1).alias("run"),
        "_id", "_hash", F.col("first").alias("pos"))
    return onward.union(upto).distinct()


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose ``keys`` occur more than once, with ``rank``: the first place of these keys."""
    found = (rows.groupBy(*keys).agg(F.min("place").alias("rank"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "rank"))
    groups = checkpointed(found)
    on = None
    for i, k in enumerate(keys):
        same = F.col(k) == F.col(f"_k{i}")
        on = same if on is None else on & same
    return rows.drop("rank").join(groups, on).drop(*[f"_k{i}" for i in range(len(keys))])


def later_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _hash, pos, run): the shortest runs that begin at an earlier place as well, and ``source``, that place."""
    level = materialise(_ranked(lines.select("place", (F.col("n") - F.col("pos")).alias("left"), "h1", "h2"), ["h1", "h2"])
                        .select("place", "left", "rank"))
    runs = checkpointed(shortest_runs(lines, min_words).join(level.select("place"), "place", "left_semi"))
    longest = runs.agg(F.max("run").alias("m")).first()["m"] or 0
    tested, size = [], 1
    while size <= longest:
        ends = level.select(F.col("place").alias("_end"), F.col("rank").alias("tail"))
        tested.append(runs.where((F.col("run") >= size) & (F.col("run") < 2 * size))
                      .join(level.select(F.col("place").alias("_from"), F.col("rank").alias("head")), F.col("place") == F.col("_from"))
                      .join(ends, F.col("place") + F.col("run") - size == F.col("_end"))
                      .select("place", "run", "head", "tail", "_id", "_hash", "pos"))
        if 2 * size <= longest:
            second = level.select((F.col("place") - size).alias("_place"), F.col("rank").alias("second"))
            pairs = (level.where(F.col("left") >= 2 * size).withColumnRenamed("rank", "first")
                     .join(second, F.col("place") == F.col("_place")).select("place", "left", "first", "second"))
            level = materialise(_ranked(materialise(pairs), ["first", "second"]).select("place", "left", "rank"))
        size *= 2
    if not tested:
        return lines.sparkSession.createDataFrame([], runs.drop("place").schema.add("source", "long"))
    every = tested[0]
    for t in tested[1:]:
        every = every.union(t)
    same = _ranked(materialise(every), ["run", "head", "tail"])
    return same.where(F.col("rank") < F.col("place")).select("_id", "_hash", "pos", "run", F.col("rank").alias("source"))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _hash, spans): per document the maximal deleted stretches as (first line, line after the last), in order."""
    runs = later_runs(line_table(docs), min_words).groupBy("_id", "_hash", "pos").agg(F.max("run").alias("run"))
    doc = Window.partitionBy("_id", "_hash").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("run")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col("pos")).cast("int"))
    island = F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, 0))
    return (opened.withColumn("_island", island).groupBy("_id", "_hash", "_island")
            .agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("run")).alias("b"))
            .groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")))


def _kept_text(lines: Column, spans: Column) -> Column:
    """The lines outside ``spans``, joined; null if none is left."""
    n = F.size(spans)
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["b"]).alias("a"),
        F.when(i == n, F.size(lines)).otherwise(F.get(spans, i)["a"]).alias("b")))
    kept = F.filter(gaps, lambda g: g["a"] < g["b"])
    parts = F.transform(kept, lambda g: F.array_join(F.slice(lines, g["a"] + 1, g["b"] - g["a"]), "\n"))
    return F.when(F.size(kept) > 0, F.array_join(parts, "\n"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, kept, n_lines, n_removed, n_runs) for every row of ``docs`` (doc_id, text and any columns): the row
    itself, its text without repeated runs (null if nothing is left or the text is null), and counts.

    Null texts have no lines; an empty text is one empty line; rows with equal id and text count as
    one document and are cut alike, so repeated rows do not delete each other; null ids come last in
    the order; no rows give no rows.
    """
    spans = materialise(deletions(docs.select("doc_id", "text"), min_words)).select(
        F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "spans").hint("merge")  # spans grow with the corpus
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    found = rows.join(spans, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    text = F.col("row.text")
    lines = F.split(text, "\n", -1)
    removed = F.aggregate("spans", F.lit(0), lambda x, s: x + s["b"] - s["a"])
    return found.select(
        "row", F.when(F.col("spans").isNull(), text).otherwise(_kept_text(lines, F.col("spans"))).alias("kept"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_runs"))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_sha256), one row for every row of ``docs``."""
    kept = F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256)
    return without_repeats(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", kept.alias("kept_sha256"))


def cut_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs cut from the texts and n_chars, if there, brought up to date; documents of
    which no line is left go.  Rows keep all their columns."""
    changed = F.col("n_removed") > 0
    cut = without_repeats(docs).where(~changed | F.col("kept").isNotNull())

    def value(c: str):
        old = F.col("row")[c]
        if c == "text":
            return F.col("kept").alias(c)
        if c == "n_chars":
            return F.when(changed, F.length("kept")).otherwise(old).cast(docs.schema[c].dataType).alias(c)
        return old.alias(c)

    return cut.select(*[value(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP7_SQL = """
with d as (select distinct doc_id, text from documents where text is not null),
l as (
  select doc_id, text as whole, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from d),
w as (select doc_id, whole, line, pos, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words from l),
c as (select *, sum(words) over (partition by doc_id, whole order by pos) as through,
             sum(words) over (partition by doc_id, whole order by pos) - words as before from w),
runs as (
  select a.doc_id, a.whole, a.pos as a, min(b.pos) as b
  from c a join c b on a.doc_id is not distinct from b.doc_id and a.whole = b.whole and b.pos >= a.pos
  where b.through - a.before >= 10 group by 1, 2, 3
  union
  select b.doc_id, b.whole, max(a.pos) as a, b.pos as b
  from c a join c b on a.doc_id is not distinct from b.doc_id and a.whole = b.whole and b.pos >= a.pos
  where b.through - a.before >= 10 group by 1, 2, 4),
t as (
  select doc_id, whole, a, b, array_to_string(list_slice(string_split(whole, chr(10)), a + 1, b + 1), chr(10)) as run
  from runs),
f as (select *, min(struct_pack(d := doc_id, a := a)) over (partition by run) as first from t),
later as (select doc_id, whole, a, b from f where first < struct_pack(d := doc_id, a := a)),
gone as (select distinct c.doc_id, c.whole, c.pos from c join later r
         on c.doc_id is not distinct from r.doc_id and c.whole = r.whole and c.pos between r.a and r.b),
per as (
  select l.doc_id, l.whole, count(*) as n_lines, count(g.pos) as n_removed,
         coalesce(string_agg(case when g.pos is null then line end, chr(10) order by l.pos), '') as kept
  from l left join gone g on l.doc_id is not distinct from g.doc_id and l.whole = g.whole and l.pos = g.pos group by 1, 2),
s as (select doc_id, whole, count(*) as n_runs from (
        select *, pos - row_number() over (partition by doc_id, whole order by pos) as k from gone)
      group by doc_id, whole, k),
n as (select doc_id, whole, count(*) as n_runs from s group by 1, 2)
select x.doc_id, coalesce(p.n_lines, 0) as n_lines, coalesce(p.n_removed, 0) as n_removed,
       coalesce(n.n_runs, 0) as n_runs, sha256(coalesce(p.kept, '')) as kept_sha256
from documents x
left join per p on x.doc_id is not distinct from p.doc_id and x.text = p.whole
left join n on x.doc_id is not distinct from n.doc_id and x.text = n.whole
"""
