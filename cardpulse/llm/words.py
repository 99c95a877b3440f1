"""Cutting many texts into words at once, and chunks of texts of bounded size, for functions on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, BLANK, END = 0, 1, 2
CHUNK_BYTES = 12 << 20
LOWER = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), np.arange(65, 91)).astype(np.uint8)


def byte_classes(blanks: bytes, ends: bytes = b"") -> np.ndarray:
    """A table of byte classes: ``blanks`` part words, ``ends`` part words and end a piece, the rest make words."""
    out = np.zeros(256, np.uint8)
    out[np.frombuffer(blanks, np.uint8)] = BLANK
    out[np.frombuffer(ends, np.uint8)] = END
    return out


@dataclass
class Words:
    """The words of some texts in order: their number in ``vocabulary``, their text and their piece."""

    codes: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    vocabulary: pa.Array


def split(texts: pa.Array, classes: np.ndarray) -> Words:
    """The words of ``texts`` (null: none) with A-Z in lower case.  Words and pieces never cross texts."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(none, none, none, pa.array([], pa.large_binary()))
    data = LOWER[data]
    kind = classes[data]
    word = kind == WORD
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | first[1:-1]
    starts = np.nonzero(starts)[0]
    upto = np.cumsum(word)
    bounds = np.append(upto[starts] - 1, upto[-1]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts),
                                             [None, pa.py_buffer(bounds), pa.py_buffer(data[word])])
    encoded = array.dictionary_encode()
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(kind == END)[starts] + row
    return Words(encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, piece, encoded.dictionary)


def distinct(words: Words, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each, an occurrence of each, count of each) of the different phrases of ``n`` words that
    start at the places ``at``.  Exact: phrases are told apart by their words' numbers."""
    size = max(1, len(words.vocabulary))
    ids = words.codes[at]
    for k in range(1, n):
        ids = np.unique(ids * size + words.codes[at + k], return_inverse=True)[1]
    _, where, ids, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    return ids, at[where], count


def phrases(words: Words, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of ``n`` words from the places ``at`` on, joined by one blank."""
    parts = [words.vocabulary.take(pa.array(words.codes[at + k])) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts take at most ``most`` bytes together, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, lo = np.cumsum(size), 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
