"""Words, lines and their hashes over Arrow batches of texts, vectorised with NumPy.

A word is a maximal run of bytes other than space and tab to carriage return. A null text
has no words. A word has a keyed 128-bit hash, of which sums over runs of words are made: up
to 16 bytes are taken as two numbers, which tell all such words apart, and mixed with numbers
drawn from the key; longer words have a BLAKE2b digest. With a key that is drawn per run
(`new_key`) no text can be written so that two words or runs of it collide. Without one,
hashes are the same in every process and run.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U64 = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of an unsigned 64-bit number over all bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """`n` odd 64-bit numbers that depend on the seed only."""
    steps = np.arange(1, n + 1, dtype=_U64) + _U64(seed) * _U64(1 << 20)
    return mix(steps * _U64(0x9E3779B97F4A7C15)) | _U64(1)


def _lower_bytes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


_LOWER = _lower_bytes()
#: Masks for the first n bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)
#: The key of hashes that are the same in every run.
PUBLIC = b""


def new_key() -> bytes:
    """A key for the hashes of one run; drawn on the driver, so that all its tasks share it."""
    return secrets.token_bytes(16)


def digests(values: pa.Array, key: bytes = PUBLIC) -> np.ndarray:
    """Two 64-bit numbers for each value of a binary column, as two rows."""
    found = [hashlib.blake2b(v, digest_size=16, key=key).digest() for v in values.to_pylist()]
    return np.frombuffer(b"".join(found), "<u8").astype(_U64).reshape(-1, 2).T


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds.astype(np.int64)


class Texts:
    """Some texts of a batch: `first` to `last` (exclusive) are their rows in it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, last: int):
        self.first, self.last = first, last
        self.bounds = bounds[first : last + 1] - bounds[first]
        self.data = data[bounds[first] : bounds[last]]
        self.n = last - first
        self.inside = ~_SPACES[self.data]
        before = np.empty_like(self.inside)
        before[:1] = False
        before[1:] = self.inside[:-1]
        # A text ends the word of the text before it.
        cuts = self.bounds[:-1][np.diff(self.bounds) > 0]
        before[cuts] = False
        self.starts = np.flatnonzero(self.inside & ~before)
        stops = np.empty_like(self.inside)
        stops[:-1] = ~self.inside[1:]
        stops[-1:] = True
        stops[cuts[cuts > 0] - 1] = True
        self.ends = np.flatnonzero(self.inside & stops) + 1
        self.text_of = np.searchsorted(self.bounds, self.starts, "right") - 1
        self.first_word = np.searchsorted(self.starts, self.bounds)
        self.n_words = np.diff(self.first_word)

    def spans(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> pa.DictionaryArray:
        """Stretches of bytes that don't overlap, as a column of numbered values; `fold`
        takes A-Z as a-z. Equal numbers are equal bytes."""
        edges = np.zeros(len(self.data) + 1, np.int8)
        edges[starts] += 1
        np.subtract.at(edges, ends, 1)
        data = self.data[np.cumsum(edges[:-1], dtype=np.int8).astype(bool)]
        if fold:
            data = _LOWER[data]
        bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
        return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()

    def word_lanes(self, fold: bool = False, key: bytes = PUBLIC) -> np.ndarray:
        """Two 64-bit hashes per word, as two rows; together they tell words apart."""
        sizes = self.ends - self.starts
        data = np.zeros(len(self.data) + 16, np.uint8)
        data[: len(self.data)] = _LOWER[self.data] if fold else self.data
        eights = np.ndarray(len(self.data) + 9, "<u8", data, strides=(1,))
        low = eights[self.starts] & _MASKS[np.minimum(sizes, 8)]
        high = eights[self.starts + 8 * (sizes > 8)] & _MASKS[np.clip(sizes - 8, 0, 8)]
        drawn = np.frombuffer(hashlib.blake2b(b"lanes", digest_size=64, key=key).digest(), "<u8").astype(_U64)
        out = np.empty((2, len(sizes)), _U64)
        for lane in range(2):
            a, b, c, d = drawn[4 * lane : 4 * lane + 4]
            first = mix((low ^ a) * (b | _U64(1)))
            out[lane] = mix((first + (high ^ c)) * (d | _U64(1)) + sizes.astype(_U64))
        long = np.flatnonzero(sizes > 16)
        if len(long):
            words = self.spans(self.starts[long], self.ends[long], fold)
            out[:, long] = digests(words.dictionary, key)[:, words.indices.to_numpy()]
        return out

    def word_hashes(self, fold: bool = False, key: bytes = PUBLIC) -> np.ndarray:
        return self.word_lanes(fold, key)[0]

    def counted(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.bounds])

    def windows(self, size: int) -> np.ndarray:
        """Index of the first word of every run of `size` words in one text."""
        last = np.repeat(self.first_word[1:], self.n_words)
        return np.flatnonzero(np.arange(len(self.starts)) + size <= last)


def window_hashes(words: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """Hash of the run of `size` words that starts at each word, as far as there is one."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U64)
    factors = constants(seed, size)
    out = words[:n] * factors[0]
    for k in range(1, size):
        out += words[k : k + n] * factors[k]
    return mix(out)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a column in order, about `limit` bytes at a time (one at least)."""
    data, bounds = string_buffers(column)
    rows, first = len(bounds) - 1, 0
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield Texts(data, bounds, first, last)
        first = last


def shingle_sets(texts: Texts, size: int, fold: bool, key: bytes = PUBLIC) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words of each text: hashes and bounds.

    A text with fewer words has its whole sequence as one shingle; one without words has
    none. The hashes of a text are sorted.
    """
    words = texts.word_hashes(fold, key)
    at = texts.windows(size)
    hashes = window_hashes(words, size)[at] if len(at) else np.zeros(0, _U64)
    owner = texts.text_of[at]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < size))
    if len(short):
        whole = np.empty(len(short), _U64)
        for k, text in enumerate(short):
            own = words[texts.first_word[text] : texts.first_word[text + 1]]
            whole[k] = window_hashes(own, len(own), 7)[0]
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(texts.n + 1))


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array as a binary column, little-endian."""
    values = np.ascontiguousarray(values)
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]
    )
