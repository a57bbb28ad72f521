"""Text kernels over Arrow arrays: words and counts of whole texts, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a kernel handles at once; a longer single text is handled alone.
PIECE = 6 << 20


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about limit text bytes, so that memory doesn't follow the batch size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    del batch
    pa.default_memory_pool().release_unused()  # a worker lives on, beside others


def filled(texts: pa.Array) -> pa.Array:
    """Null texts as empty ones, in a fresh array that starts at offset 0."""
    return pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a filled array."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words [^\\x20\\x09-\\x0D]+ of the texts in a row, and where each text's words begin (one more entry than texts)."""
    split = pc.ascii_split_whitespace(texts)
    flat, starts = split.flatten(), np.asarray(split.offsets, np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        starts, flat = np.concatenate([[0], np.cumsum(full)])[starts - starts[0]], flat.filter(pa.array(full))
    return flat, starts - starts[0]


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values over each text's stretch."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words."""
    if not len(flat):
        return np.zeros(0, np.int64), flat
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of numbers (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, starts: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text, its words that lie in a window of width words found twice or more in that text.

    Windows meet by a 64-bit hash; those that meet are compared word by word, and a text with a false meeting is
    counted again from the windows themselves.
    """
    counts = np.zeros(len(starts) - 1, np.int64)
    if len(ids) < width:
        return counts
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    n = len(ids) - width + 1
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    m, h = mixed(ids), mixed(text[:n])
    for j in range(width):
        h += m[j : j + n] * np.uint64(2 * j * 0x9E3779B97F4B + 1)
    again = pd.Series(h[at]).duplicated(keep=False).to_numpy()
    if not again.any():
        return counts
    at = at[again]
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at][1:] == h[at][:-1]
    window = ids[at[:, None] + np.arange(width)]
    differ = same & ((window[1:] != window[:-1]).any(1) | (text[at][1:] != text[at][:-1]))
    wrong = np.unique(np.concatenate([text[at[1:]][differ], text[at[:-1]][differ]]))
    marks = np.zeros(len(ids) + 1, np.int64)
    marks[at] += 1
    np.subtract.at(marks, at + width, 1)
    counts = per_text((np.cumsum(marks[:-1]) > 0).astype(np.int64), starts)
    for t in wrong:
        own = ids[starts[t] : starts[t + 1]]
        _, inverse, times = np.unique(np.lib.stride_tricks.sliding_window_view(own, width), axis=0, return_inverse=True, return_counts=True)
        covered = np.zeros(len(own), bool)
        for i in np.flatnonzero(times[inverse.ravel()] > 1):
            covered[i : i + width] = True
        counts[t] = covered.sum()
    return counts


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text (a filled array); also words equal to
    the one before (n_adjacent), ASCII capitals and exclamation marks."""
    flat, starts = words(texts)
    ids, _ = coded(flat)
    offsets, data = raw(texts)
    split = pc.split_pattern(texts, "\n")
    line, lines_at = split.flatten(), np.asarray(split.offsets, np.int64)
    lines_at = lines_at - lines_at[0]
    dup = np.zeros(len(texts), np.int64)
    if len(line):
        line_ids, distinct = coded(line)
        worded = (pc.binary_length(pc.ascii_trim_whitespace(distinct)).to_numpy(zero_copy_only=False) > 0)[line_ids]
        text = np.repeat(np.arange(len(texts)), np.diff(lines_at))
        dup = per_text((worded & pd.Series(text * np.int64(len(distinct)) + line_ids).duplicated().to_numpy()).astype(np.int64), lines_at)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    again = np.zeros(len(ids), np.int64)
    again[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    own = data[offsets[0] : offsets[-1]]
    return {
        "n_adjacent": per_text(again, starts), "n_capitals": per_text(((own >= 65) & (own <= 90)).astype(np.int64), offsets - offsets[0]), "n_calls": per_text((own == 33).astype(np.int64), offsets - offsets[0]),
        "n_words": np.diff(starts), "word_chars": per_text(pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64), starts),
        "n_symbols": per_text(_SYMBOL[data[offsets[0] : offsets[-1]]], offsets - offsets[0]), "n_dup_lines": dup, "n_repeat_words": repeated_words(ids, starts),
    }
