"""Language identification by a byte-level convolutional network.

The network embeds bytes, runs filters of several widths over a fixed-length window, keeps each
filter's maximum over the window, and applies a softmax layer.  It is trained in numpy on labelled
text (windows of at most about ``SAMPLE_ROWS`` documents, chosen by a hash of the id; the bound is
a parameter) and sent to the executors, where every whole text is cut into windows of ``WINDOW``
bytes, scored in batches, and its windows' class probabilities are averaged by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.common import share_of, table
from cardpulse.llm.toxicity import held_out

SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 1_024       # of each training text, from a place that depends on its hash
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 6
EPOCHS = 6
BATCH = 256
SEED = 6
HELD_OUT = (4, 2)
UNKNOWN = "und"
WORD_CHARACTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether some character is a letter; numerals such as a raised 2 or a circled 1 are none."""
    return any(m.group().isalpha() for m in WORD_CHARACTER.finditer(text))


@dataclass
class Network:
    classes: list[str]
    embedding: np.ndarray   # 256 x DIM
    kernel: np.ndarray      # widest * DIM x filters, zero beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def _kernel_mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * DIM, FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w * DIM, i * FILTERS:(i + 1) * FILTERS] = 1
    return mask


def _unfold(net: Network, windows: np.ndarray) -> np.ndarray:
    """(windows * positions, widest * DIM): the embedded bytes under the filters at each position."""
    e = net.embedding[windows]
    span = max(WIDTHS)
    places = windows.shape[1] - span + 1
    view = np.lib.stride_tricks.sliding_window_view(e.reshape(len(windows), -1), span * DIM, axis=1)[:, ::DIM]
    return np.ascontiguousarray(view).reshape(len(windows) * places, span * DIM)


def forward(net: Network, windows: np.ndarray) -> np.ndarray:
    """Class probabilities of each window (rows of ``WINDOW`` bytes, short ones padded with zero)."""
    h = (_unfold(net, windows) @ net.kernel).reshape(len(windows), -1, net.kernel.shape[1]).max(axis=1) + net.bias
    z = np.maximum(h, 0) @ net.dense + net.dense_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, y: np.ndarray, classes: list[str], epochs: int = EPOCHS, rate: float = 0.005) -> Network:
    """Adam on the cross entropy, gradients written out."""
    rng = np.random.default_rng(SEED)
    n_filters, mask = FILTERS * len(WIDTHS), _kernel_mask()
    net = Network(classes, rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
                  rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask, np.zeros(n_filters, np.float32),
                  rng.normal(0, 0.3, (n_filters, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))
    net.embedding[0] = 0
    names = ["embedding", "kernel", "bias", "dense", "dense_bias"]
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    span, step = max(WIDTHS), 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 128):
            at = order[lo:lo + 128]
            x, t = windows[at], y[at]
            u = _unfold(net, x)
            c = (u @ net.kernel).reshape(len(at), -1, n_filters)
            top = c.argmax(axis=1)
            h = np.take_along_axis(c, top[:, None], axis=1)[:, 0] + net.bias
            a = np.maximum(h, 0)
            z = a @ net.dense + net.dense_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), t] -= 1
            p /= len(at)
            dh = (p @ net.dense.T) * (h > 0)
            g = {"dense": a.T @ p, "dense_bias": p.sum(axis=0), "bias": dh.sum(axis=0),
                 "kernel": np.zeros_like(net.kernel), "embedding": np.zeros_like(net.embedding)}
            u3 = u.reshape(len(at), -1, span * DIM)
            best = u3[np.arange(len(at))[:, None], top]          # batch x filters x span * DIM
            g["kernel"] = np.einsum("bf,bfk->kf", dh, best) * mask
            de = (dh[:, :, None] * net.kernel.T[None]).reshape(len(at), n_filters, span, DIM)
            under = x[np.arange(len(at))[:, None, None], top[:, :, None] + np.arange(span)]
            np.add.at(g["embedding"], under, de)
            g["embedding"][0] = 0
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                setattr(net, k, (getattr(net, k) - rate * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32))
    return net


def cut(data: bytes, window: int = WINDOW) -> np.ndarray:
    """The whole of ``data`` as rows of ``window`` bytes, the last padded with zero."""
    n = max(1, -(-len(data) // window))
    return np.frombuffer(data.ljust(n * window, b"\0"), np.uint8).reshape(n, window)


def _training_windows(data: bytes, rng: np.random.Generator) -> np.ndarray:
    """Full windows of the text, and as many cut short at random, for short texts."""
    full = cut(data)
    short = full.copy()
    for row, keep in zip(short, rng.integers(12, WINDOW, len(short))):
        row[keep:] = 0
    return np.vstack([full, short[::2]])


def fit(docs: DataFrame, rule: tuple[int, int] = HELD_OUT, sample_rows: int = SAMPLE_ROWS) -> Network | None:
    """Train on the rows of ``docs`` (doc_id, text, lang) whose lang is known and that are not held out; None
    if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)
                       & ~held_out(F.col("doc_id"), rule))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return None
    each = sample_rows / len(n)
    pick = F.lit(False)
    part = share_of("doc_id", "language")
    for lang, k in n.items():
        pick = pick | ((F.col("lang") == lang) & (part < min(1.0, each / k)))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - SAMPLE_BYTES)) + 1
    rows = known.where(pick).select("lang", F.substring("text", start.cast("int"), F.lit(SAMPLE_BYTES)).alias("text")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    rng, classes = np.random.default_rng(SEED), sorted(n)
    cuts = [_training_windows(r["text"].encode()[:SAMPLE_BYTES], rng) for r in rows]
    y = np.repeat([classes.index(r["lang"]) for r in rows], [len(c) for c in cuts])
    return train(np.vstack(cuts), y, classes)


def classify(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean class probabilities of each whole text over its windows, weighted by length."""
    out = np.zeros((len(texts), len(net.classes)))
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        owner = np.concatenate([np.full(len(w), i) for i, w in held])
        windows = np.vstack([w for _, w in held])
        weight = np.maximum((windows != 0).sum(axis=1), 1)
        for lo in range(0, len(windows), BATCH):
            p = forward(net, windows[lo:lo + BATCH])
            np.add.at(out, owner[lo:lo + BATCH], p * weight[lo:lo + BATCH, None])
        held.clear()
        size = 0

    for i, data in enumerate(texts):
        windows = cut(data)
        for lo in range(0, len(windows), 8192):
            held.append((i, windows[lo:lo + 8192]))
            size += len(held[-1][1])
            if size >= 8192:
                flush()
    if held:
        flush()
    return out / out.sum(axis=1, keepdims=True)


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for every row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter, and all texts if no language is known, are ``und`` with
    score 0; a null id is not held out and may teach; repeated rows are predicted alike; no rows
    give no rows; other columns are not read.
    """
    net = fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), "text")
    schema = rows.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            at, texts = [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                if t is not None and net is not None and has_letter(t):
                    at.append(i)
                    texts.append(t.encode())
            if at:
                p = classify(net, texts)
                for i, k, s in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    names[i], score[i] = net.classes[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
