"""Vectorised words, lines and hashes over many texts at once.

A Grid joins the UTF-8 texts of a block of rows into one byte array, a newline after each, so that
words and lines of all rows come from a few numpy passes. Names of words, lines and word windows are
64-bit polynomial hashes with random byte values, made from prefix sums modulo 2**64; they depend on
content alone, so that every task gives equal content the same name without asking any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six bytes between words, [\x20\x09-\x0D].
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Texts of about so many bytes are worked on at once.
BLOCK_BYTES = 1 << 20
#: Spans within so many values share one pass of prefix sums.
REACH = 1 << 18
#: Ids of rows whose doc_id is null count as larger than all others.
NO_ID = (1 << 63) - 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are neither an ASCII letter or digit nor of another character: they part terms.
TERM_GAP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CRC = _crc_table()


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=16)
def _byte_values(seed: int, fold: bool) -> np.ndarray:
    values = mix(np.arange(256, dtype=np.uint64) + np.uint64(977 * (seed + 1)), seed)
    return values[LOWER] if fold else values


@lru_cache(maxsize=16)
def _powers(seed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a seeded odd base, and of its inverse, up to 2**bits."""
    base = int(mix(np.array([seed + 31], np.uint64))[0]) | 5
    out = []
    for b in (base, pow(base, -1, 2**64)):
        row = np.full((1 << bits) + 1, b, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row))
    return out[0], out[1]


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hash of values[s:e] of each span; equal contents at other places hash alike.

    Spans further apart than REACH are summed in separate passes, so that memory stays bounded.
    """
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + REACH, "right")))
        hi = int(ends[j - 1])
        bits = REACH.bit_length() if hi - lo <= REACH else (hi - lo).bit_length()
        up, down = _powers(seed, bits)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[lo:hi] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return out


def _piecewise(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, fold: bool) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    table = _byte_values(seed, fold)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + REACH, "right")))
        hi = int(ends[j - 1])
        out[i:j] = span_sums(table[buf[lo:hi]], starts[i:j] - lo, ends[i:j] - lo, seed)
        i = j
    return out


class Grid:
    """The texts of a block of rows; `start` and `end` are their byte positions in `buf`."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        raw = b"\n".join(texts) + b"\n" if texts else b""
        self.raw = raw
        self.buf = np.frombuffer(raw, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, self.n)
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def words(self, gap: np.ndarray = IS_SPACE) -> "Grid":
        """Find words, parted by the bytes of `gap`: ws, we are their bytes; doc d has the words wlo[d] to whi[d]."""
        space = gap[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.ws, self.we = edge[0::2], edge[1::2]
        self.wlo = np.searchsorted(self.ws, self.start)
        self.whi = np.searchsorted(self.ws, self.end)
        self.wdoc = np.repeat(np.arange(self.n), self.whi - self.wlo)
        return self

    def lines(self) -> "Grid":
        """Find lines (split at newline; an empty text has one): ls, le are their bytes."""
        self.le = np.flatnonzero(self.buf == 10)
        self.ls = np.concatenate([[0], self.le[:-1] + 1]) if len(self.le) else self.le
        self.llo = np.searchsorted(self.le, self.start)
        self.lhi = np.searchsorted(self.le, self.end) + 1
        self.ldoc = np.repeat(np.arange(self.n), self.lhi - self.llo)
        return self

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0, fold: bool = False) -> np.ndarray:
        """A 64-bit name of each byte span; with fold, A-Z count as a-z."""
        h = _piecewise(self.buf, starts, ends, seed, fold)
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), seed)

    def points(self) -> np.ndarray:
        """points()[i]: code points in buf[:i]."""
        out = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=out[1:])
        return out

    def per_doc(self, docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Count, or sum of integer weights, by row."""
        got = np.bincount(docs, weights=weights, minlength=self.n)
        return got.astype(np.int64)


def crc32_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None, most: int = 64) -> np.ndarray:
    """crc32 of each span, going on from the checksums `before`; bytes beyond `most` of a span come one span at a time."""
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still open are a prefix
    at, size = starts[order], (ends - starts)[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32) if before is None else before.astype(np.uint32)[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(min(most, int(size[0])) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))
        state[:m] = CRC[(state[:m] ^ buf[at[:m] + k]) & 0xFF] ^ (state[:m] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -most, "left"))):
        state[i] = zlib.crc32(buf[at[i] + most : at[i] + size[i]].tobytes(), int(state[i]))
    out = np.empty(len(at), np.uint32)
    out[order] = state
    return out


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A name for each run of `width` consecutive values of h; the result is width - 1 shorter."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width <= 8:
        out = np.zeros(n, np.uint64)
        base = _powers(seed, 10)[0][1]
        for k in range(width):
            out = out * base + h[k : k + n]
        return mix(out, seed)
    at = np.arange(n)
    return mix(span_sums(h, at, at + width, seed), seed)


def inside(wlo: np.ndarray, whi: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Whether the window of `width` words from each word stays in its row (length n_words - width + 1)."""
    ok = np.zeros(max(0, n_words) + 1, np.int32)
    has = whi - wlo >= width
    np.add.at(ok, wlo[has], 1)
    np.add.at(ok, whi[has] - width + 1, -1)
    return np.cumsum(ok)[: max(0, n_words - width + 1)] > 0


def covered(starts: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Words that a window of `width` words from one of `starts` covers."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n_words), -1)
    return np.cumsum(step)[:n_words] > 0


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches to blocks of rows with about `size` bytes of text; null is the empty text.

    A text that is longer is a block of its own, whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
        upto = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < len(upto):
            before = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + size, "right")))
            yield batch.slice(at, end - at), [x or b"" for x in col.slice(at, end - at).to_pylist()]
            at = end


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """The id column as int64, NO_ID where null."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def longs(h: np.ndarray) -> pa.Array:
    """64-bit names as a Spark long column."""
    return pa.array(h.view(np.int64) if h.dtype == np.uint64 else h)
