"""64-bit hashes of words and of runs of words, computed for whole Arrow batches with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  In UTF-8 no other character contains those bytes, so
bytes give the same words as code points.  A word's hash is a polynomial over random byte values modulo 2**64,
read off a running sum and then mixed; a run of words is hashed the same way over its words' hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_VALUE = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64)
_BASE, _RUN = _U(0x9E3779B97F4A7C15 | 1), _U(0xD6E8FEB86659FD93 | 1)
#: Words longer than this are hashed one by one with xxhash: a polynomial modulo 2**64 is weak for long strings.
LONG_WORD = 256
#: Bytes, and words, that are hashed at once.
PART = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * _U(pow(int(base), done, 1 << 64))
            done += step
        _powers[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them): consecutive rows of at most ``most``
    bytes together, or one longer row.  A null text counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1] or bytes(8), dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive rows, and each row's first word (one more entry at the end).

    More than about ``PART`` bytes are taken part by part, cut between words, so a long row needs, besides itself, 16
    bytes for each word (and a single word of more than ``PART`` bytes some 30 times its size)."""
    if len(data) <= PART:
        first, out = _words(data, offsets, lower)
        return out, np.searchsorted(first, offsets)
    firsts, outs, begin = [], [], 0
    while begin < len(data):
        end = begin + PART
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[end : end + PART]])
            if len(gap):
                end += int(gap[0])
                break
            end += PART
        end = min(end, len(data))
        first, out = _words(data[begin:end], np.clip(offsets - begin, 0, end - begin), lower)
        firsts.append(first + begin)
        outs.append(out)
        begin = end
    return np.concatenate(outs), np.searchsorted(np.concatenate(firsts), offsets)


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * powers(_BASE, n), out=total[1:])
    out = (total[last] - total[first]) * powers(inverse(_BASE), n)[first]
    out = mix(out + (last - first).astype(np.uint64))
    for i in np.flatnonzero(last - first > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[first[i] : last[i]].tobytes(), seed=7)
    return first, out


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of ``length`` words that starts at each word (shorter by ``length`` - 1 than ``hashes``)."""
    n = len(hashes)
    if n < length:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(n - length + 1, dtype=np.uint64)
    for a in range(0, len(out), PART):
        own = hashes[a : a + PART + length - 1]
        total = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(own * powers(_RUN, len(own)), out=total[1:])
        out[a : a + PART] = mix((total[length:] - total[:-length]) * powers(inverse(_RUN), len(own))[: len(own) - length + 1] + _U(length))
    return out
