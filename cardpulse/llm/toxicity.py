"""Toxicity by weak supervision.

Voters.  Over the labelled rows open to learning, words, word beginnings (4 to 8 letters) and either
of them making up 1 % of a text's words, if they appear far more often in toxic rows, are counted
by Spark; a greedy cover picks those that between them reach the toxic rows.  Each is one lexicon
(word) or pattern (beginning, share) voter; fixed insult lexicons, second-person address and
shouting vote as well, and so does the annotator's label.

Label model.  A latent class for each row explains the votes; its parameters, each voter's rates
in both classes and a tree of dependences between voters that agree beyond what the class
explains, are estimated by expectation maximisation.  Its posteriors are the training labels.

Classifier.  A logistic regression on the logarithmic counts and the shares of the chosen words,
beginnings and lexicons, trained on the posteriors, scores every whole text.  A row's label, language, source and id are
never inputs of its score.

The classifier is fitted on at most about ``SAMPLE_ROWS`` labelled rows, chosen by a hash of the
id; scoring covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import fresh, materialise, share_of, slices, table

SAMPLE_ROWS = 15_000
CANDIDATES = 800
MIN_LIFT = 10.0
MIN_SHARE = 0.004
COVER = 3
BEGINNINGS = (4, 5, 6, 7, 8)
DENSE = 0.01               # share of a text's words
MOST_SHARE = 1.5           # percent
CUT = 0.7
HELD_OUT = (3, 1)
WORD = re.compile(r"[^\W\d_]+")
# Insult lexicons of the fixed voters.
INSULTS = {
    "en": "idiot moron stupid scum trash loser worthless pathetic disgusting clown dumb imbecile filth vermin",
    "de": "idiot dummkopf abschaum trottel versager wertlos ekelhaft arschloch",
    "fr": "idiot imbécile ordure crétin minable dégoûtant salaud connard",
    "es": "idiota imbécil basura escoria inútil asqueroso cabrón estúpido",
}
LEXICONS = {lang: frozenset(words.split()) for lang, words in INSULTS.items()}
ADDRESS = re.compile(r"\b(?:you|your|du|dein|tu|vous|votre|usted)\b\W+(?:\w+\W+){0,3}(?:%s)"
                     % "|".join(sorted({w for ws in INSULTS.values() for w in ws.split()})))
SHOUT = re.compile(r"!{3,}")


def held_out(doc_id: Column, rule: tuple[int, int] = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % rule[0] == rule[1], F.lit(False))


def word_features(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def dense(feature: str) -> str:
    """The name of the pattern that at least ``DENSE`` of a text's words are the feature."""
    return feature + "%"


def base(name: str) -> str:
    return name.removesuffix("%")


def text_features(text: str) -> set[str]:
    words = Counter(WORD.findall(text.lower()))
    n = words.total()
    times: Counter = Counter()
    for w, k in words.items():
        for f in word_features(w):
            times[f] += k
    return times.keys() | {dense(f) for f, k in times.items() if k >= DENSE * n}


def word_hits(word: str, wanted) -> tuple[str, ...]:
    """The features of a word that are in ``wanted``, lexicons included."""
    return tuple(f for f in word_features(word) if f in wanted) + \
        tuple(f"insults {k}" for k, ws in LEXICONS.items() if word in ws and f"insults {k}" in wanted)


def feature_values(times: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the classifier sees of feature counts (rows x features): their logarithm and their share of the words."""
    share = 100.0 * times / np.maximum(n_words, 1)[:, None]
    return np.hstack([np.log1p(times), np.minimum(share, MOST_SHARE)])


def fixed_votes(text: str, words: set[str]) -> list[int]:
    low = text.lower()
    return [int(not ws.isdisjoint(words)) for ws in LEXICONS.values()] + \
        [int(bool(ADDRESS.search(low))), int(bool(SHOUT.search(text)))]


@dataclass
class Model:
    """Classifier weights by feature, of its logarithmic count and of its share, and the label model's findings."""

    weights: dict[str, tuple[float, float]]
    bias: float
    voters: list[str] = field(default_factory=list)
    rates: np.ndarray | None = None            # voters x class: how often each votes
    dependences: list[tuple[int, int, float]] = field(default_factory=list)  # voter, voter, correlation in a class
    prior: float = 0.0


def cover(hits: np.ndarray, toxic: np.ndarray, names: list[str], times: int = COVER, least: float = MIN_SHARE) -> list[int]:
    """Greedy choice of features (columns of ``hits``) until each toxic row is reached ``times`` times
    or no feature adds enough rows."""
    need = np.where(toxic, times, 0)
    clean = hits[~toxic].sum(axis=0)
    floor = max(3.0, least * toxic.sum())
    chosen: list[int] = []
    left = np.ones(hits.shape[1], bool)
    reach = hits & toxic[:, None]
    while left.any():
        gain = reach[need > 0].sum(axis=0) - 5.0 * clean
        gain[~left] = -1
        best = max(np.nonzero(gain == gain.max())[0], key=lambda j: (len(names[j]), names[j]))
        if gain[best] < floor:
            break
        chosen.append(int(best))
        left[best] = False
        need = need - (reach[:, best] & (need > 0))
    return chosen


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 25, min_corr: float = 0.15,
                silent: np.ndarray | None = None, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Posterior of class 1 for every row of binary ``votes``, the voters' rates, and the dependences.
    A voter in ``silent`` abstains where it does not vote: a lexicon of one language says nothing of others.
    A voter ``apart`` depends on no other: an annotator reads the text, not the lexicons, and what makes them
    agree is the class.

    ``start`` gives first posteriors, ``prior`` the share of class 1.  Voters whose residuals correlate within a class
    form a tree, and each voter's rate is conditioned on its parent's vote.  The tree is found under
    the first posteriors, as one found after rounds of independent voters would miss voters that had drawn
    the class to themselves, and again every eight rounds under the posteriors of the model with its tree.
    """
    n, m = votes.shape
    v = votes.astype(float)
    post, parents, deps = start.astype(float), np.full(m, -1), []
    rates = np.zeros((m, 2))
    for it in range(rounds):
        w = np.stack([1 - post, post])
        size = w.sum(axis=1)
        rates = ((w @ v + 0.5 * np.array([[0.02], [0.3]])) / (size[:, None] + 0.5)).T.clip(1e-4, 1 - 1e-4)
        if it % 8 == 0 and m > 1:      # under the first posteriors, then again under those found since
            corr = np.zeros((m, m))
            for c in (0, 1):
                r = (v - rates[:, c]) * np.sqrt(w[c])[:, None]
                cov = r.T @ r
                sd = np.sqrt(np.diag(cov)) + 1e-9
                corr += size[c] / n * cov / sd[:, None] / sd[None, :]
            if apart is not None:
                corr[apart], corr[:, apart] = 0.0, 0.0
            parents, deps = _forest(corr, min_corr)
        logit = np.full(n, np.log(prior) - np.log1p(-prior))
        for j in range(m):
            p = parents[j]
            for value in ((None,) if p < 0 else (0, 1)):
                at = slice(None) if value is None else votes[:, p] == value
                rate = rates[j]
                if value is not None:
                    wc, vj = w[:, at], v[at, j]
                    rate = ((wc @ vj + 4 * rates[j]) / (wc.sum(axis=1) + 4)).clip(1e-4, 1 - 1e-4)
                yes = np.log(rate[1] / rate[0])
                no = 0.0 if silent is not None and silent[j] else np.log((1 - rate[1]) / (1 - rate[0]))
                logit[at] += np.where(votes[at, j], yes, no)
        post = 1 / (1 + np.exp(-logit.clip(-30, 30)))
    return post, rates, deps


def _forest(corr: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """A maximum spanning forest over correlations of at least ``least`` in size: parents and edges."""
    m = len(corr)
    parents, seen, deps = np.full(m, -1), np.zeros(m, bool), []
    strength = np.abs(corr)
    np.fill_diagonal(strength, 0)
    for root in np.argsort(-strength.max(axis=1)):
        if seen[root]:
            continue
        seen[root] = True
        inside = [root]
        while True:
            best = max(((strength[i, j], i, j) for i in inside for j in range(m) if not seen[j]), default=(0, 0, 0))
            if best[0] < least:
                break
            _, i, j = best
            parents[j], seen[j] = i, True
            inside.append(j)
            deps.append((int(i), int(j), float(corr[i, j])))
    return parents, deps


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weighted-posterior logistic regression by Newton steps, the bias not penalised."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a @ w).clip(-30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return w[:-1], float(w[-1])


def _speaking_for(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression in which no feature speaks against the class: of those that would, the one that
    does most is left out, until none does."""
    use = np.arange(x.shape[1])
    while True:
        w, bias = logistic(x[:, use], y)
        if not len(use) or (w >= 0).all():
            break
        use = np.delete(use, int(w.argmin()))
    out = np.zeros(x.shape[1])
    out[use] = w
    return out, bias


def fit(docs: DataFrame, labels: DataFrame, rule: tuple[int, int] = HELD_OUT, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks, the held-out rows
    left aside.  Of several labels of an id the highest counts; null ids, labels and texts teach nothing."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), rule))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic")))
    n = known.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = known.where(share_of("doc_id", "toxicity") < share)
    chosen = chosen.withColumnRenamed("doc_id", "_id")
    sample = materialise(docs.select("doc_id", "text").where("text is not null")
                         .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "_toxic"))
    size = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return Model({f"insults {k}": (8.0, 0.0) for k in LEXICONS}, -4.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[1].keys() | seen[0].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()),
                                              pa.array([seen[0][f] for f in names], pa.int64())], ["feature", "pos", "neg"])
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[1 if toxic else 0].update(text_features(text))
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield flush()
        yield flush()

    df = (sample.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature")
          .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
          .where((F.col("pos") >= max(2, int(MIN_SHARE * pos)))
                 & (F.col("pos") / pos >= MIN_LIFT * (F.col("neg") + 0.5) / (neg + 1)))
          .orderBy(F.desc("pos"), "neg", "feature").limit(CANDIDATES).collect())
    names = [r["feature"] for r in df]
    words_of = sorted({base(f) for f in names}) + [f"insults {k}" for k in LEXICONS]
    index = {f: i for i, f in enumerate(words_of)}
    fixed = len(fixed_votes("", set()))

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, times, size, extra = [], [], [], []
            for text in batch.column(0).to_pylist():
                words = Counter(WORD.findall(text.lower()))
                got: Counter = Counter()
                for w, k in words.items():
                    for f in word_hits(w, index):
                        got[index[f]] += k
                at.append(list(got.keys()))
                times.append(list(got.values()))
                size.append(words.total())
                extra.append(fixed_votes(text, words.keys()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(size, pa.int32()),
                 pa.array(extra, pa.list_(pa.int32())), batch.column(1)], ["at", "times", "n", "extra", "toxic"])

    rows = sample.mapInArrow(incidence, "at array<int>, times array<int>, n int, extra array<int>, toxic int").collect()
    rows.sort(key=lambda r: (r["toxic"], sorted(zip(r["at"], r["times"])), r["n"]))
    counts = np.zeros((len(rows), len(words_of)), np.uint16)
    for i, r in enumerate(rows):
        counts[i, r["at"]] = np.minimum(r["times"], 60_000)
    n_words, toxic = np.array([r["n"] for r in rows]), np.array([r["toxic"] > 0 for r in rows])
    seen = np.stack([counts[:, index[base(f)]] >= (np.maximum(1, DENSE * n_words) if f != base(f) else 1) for f in names], axis=1) \
        if names else np.zeros((len(rows), 0), bool)
    # of names that the same rows show, the longest
    distinct: dict[bytes, int] = {}
    for j in sorted(range(len(names)), key=lambda j: (-len(names[j]), names[j])):
        distinct.setdefault(np.packbits(seen[:, j]).tobytes(), j)
    keep = sorted(distinct.values())
    names, seen = [names[j] for j in keep], seen[:, keep]
    picked = cover(seen, toxic, names)
    hits = seen[:, picked]
    votes = np.hstack([hits, np.array([r["extra"] for r in rows], bool).reshape(len(rows), fixed), ~hits.any(axis=1)[:, None], toxic[:, None]])
    voters = [names[j] for j in picked] + [f"insults {k}" for k in LEXICONS] + ["address", "shouting", "nothing found", "annotator"]
    silent = np.array([v != "annotator" for v in voters])
    post, rates, deps = label_model(votes, np.where(toxic, 0.95, 0.05), float(toxic.mean()), silent=silent, apart=~silent)
    used = sorted({base(names[j]) for j in picked}) + [f"insults {k}" for k in LEXICONS]
    w, bias = _speaking_for(feature_values(counts[:, [index[f] for f in used]].astype(float), n_words), post)
    pairs = zip(used, w[:len(used)].tolist(), w[len(used):].tolist())
    return Model({f: (u, v) for f, u, v in pairs if u or v}, bias, voters, rates, deps, float(post.mean()))


def scores(model: Model, texts: list[str | None], memory: dict[str, tuple] | None = None) -> np.ndarray:
    """Score of every whole text; null counts as empty."""
    weights, out = model.weights, np.empty(len(texts))
    memory = {} if memory is None else memory
    for i, text in enumerate(texts):
        words, got = WORD.findall((text or "").lower()), {}
        for w in words:
            hits = memory.get(w)
            if hits is None:
                if len(memory) > 100_000:
                    memory.clear()
                hits = memory[w] = word_hits(w, weights)
            for f in hits:
                got[f] = got.get(f, 0) + 1
        z = model.bias
        for f, k in sorted(got.items()):
            z += weights[f][0] * np.log1p(k) + weights[f][1] * min(100.0 * k / len(words), MOST_SHARE)
        out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def scored(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """``docs`` (any columns, one of them ``text``) with a column ``out``, the score."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple] = {}
        for batch in slices(batches):
            s = scores(model, batch.column(at).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for every row of ``docs``.

    Null and empty texts get the score of a text without any known word; a null id is not held out;
    repeated rows score alike; without labelled rows of both kinds the fixed lexicons alone score;
    no rows give no rows; other columns are not read.
    """
    return scored(docs.select("doc_id", "text"), fit(docs, labels), "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; rows keep all their columns."""
    score = fresh(docs, "_score")
    return scored(docs, fit(docs, labels), score).where(F.col(score) < CUT).drop(score)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
