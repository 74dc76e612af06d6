"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time: the batch's UTF-8 buffer is
viewed as a numpy array and cut into pieces of bounded size, so the memory of a
task does not depend on how long its partition is.  A single text longer than
the bound forms a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
"""Bytes of text that are worked on at once (a longer text is worked on alone)."""

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next piece."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than texts) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts that together hold at most ``limit`` bytes."""
    data, offsets = buffers(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    pa.default_memory_pool().release_unused()  # what this batch's arrays left behind


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and, per text, where its words begin in these arrays."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the fingerprint of any span follows; for several ``span_hashes`` of one piece."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power("up", _BASE, len(data)), out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit fingerprints of byte spans, equal for equal spans wherever they stand."""
    total = byte_sums(data) if sums is None else sums
    plain = (total[ends] - total[starts]) * _power("down", _BASE_INVERSE, len(data) + 1)[starts]
    return mix(plain + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every run of ``width`` words, and where each text's runs begin.

    A text with fewer words, but at least one, has the whole sequence as its one run.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(counts)), runs)
    first = bounds[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    length = np.minimum(counts, width)[text]
    out = np.full(len(first), 0x51ED270B7A2F9C33, dtype=np.uint64)
    for k in range(width):
        at = np.minimum(first + k, len(words) - 1)
        out = np.where(k < length, mix(out * _U(0x9FB21C651E98DF25) + words[at]) if len(words) else out, out)
    return out, begin


def distinct_by_text(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's values begin."""
    out, counts = [], np.zeros(len(begin) - 1, np.int64)
    for i in range(len(counts)):
        if begin[i + 1] > begin[i]:
            own = np.sort(values[begin[i] : begin[i + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            counts[i] = len(own)
            out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])
