"""Words of Arrow string columns as numpy arrays of 64-bit hashes.

Everything here works on one Arrow batch inside a task. Texts are never made
into Python strings: word borders and hashes come from the UTF-8 bytes, in
slices of a few megabytes, so memory doesn't grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)
_SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _MULT, U))


_POWERS = _powers(1 << 16)
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))


def word_table(pattern_bytes) -> np.ndarray:
    """Which of the 256 byte values belong to words."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
SPACED = word_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
ALNUM = word_table(b for b in range(256) if b >= 0x80 or chr(b).isalnum())


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; one longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def hashed_words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z taken as a-z, and the n + 1 offsets of each row's words."""
    lower = np.arange(256)
    lower[65:91] += 32
    values = np.where(table, _BYTE[lower], U(0))
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = np.empty(len(raw) + 1, bool)
    inside[:-1] = table[raw]
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):  # words in slices of bytes
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + _SLICE)))
        lo, hi = int(starts[at]), int(starts[end]) if end < len(starts) else len(raw)
        own = starts[at:end] - lo
        pos = np.arange(hi - lo)
        pos -= np.repeat(own, np.diff(np.append(own, hi - lo)))
        with np.errstate(over="ignore"):
            part = values[raw[lo:hi]] * _POWERS[pos & 0xFFFF]
            if len(pos) > 1 << 16:
                part *= (pos >> 16).astype(U) * U(2) + U(1)
            out[at:end] = mix(np.add.reduceat(part, own))
        at = end
    return out, np.searchsorted(starts, offsets)
