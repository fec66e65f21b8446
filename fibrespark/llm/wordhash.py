"""Hashes of words and of windows of words, vectorised over the bytes of many texts.

Words are runs of bytes other than the six ASCII white-space bytes, which are the words ``[^\\x20\\x09-\\x0D]+`` of the text.
A word's hash is a polynomial over its bytes modulo 2**64 with an odd base, mixed with its length; a window's hash is a
polynomial over its words' hashes. Both come from running sums, so their cost doesn't grow with the window.

Such a polynomial loses bits on long patterned sequences (of the Thue-Morse sequence over any two letters and its complement all
64 from 1024 letters on, 19 at 32 letters), so words over ``LONG_WORD`` bytes are hashed one by one with BLAKE2b, and windows over
``LONG_WINDOW`` words are put together from two overlapping halves, mixed in between.
"""

from __future__ import annotations

import hashlib

import numpy as np

SLICE = 1 << 20
LONG_WORD = 32
LONG_WINDOW = 16
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, ... base**(n - 1) modulo 2**64; kept and grown by doubling."""
    made = _powers.get((base, 0))
    if made is None or len(made) < n:
        size = max(n, 1024) if made is None else max(n, 2 * len(made))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        made = _powers[base, 0] = np.cumprod(steps, dtype=np.uint64)
    return made[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))  # a copy; the rest is done in it
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= np.uint64(factor)
        x ^= x >> np.uint64(33)
    return x


def _slice_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start offset, hash) of each word."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASES[0], len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_inverse(_BASES[0]), len(data) + 1)[starts]
    raw = memoryview(data)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return starts, mixed(h + (ends - starts).astype(np.uint64) * np.uint64(_BASES[2]))


def words_of_texts(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), in order."""
    counts = np.zeros(len(texts), dtype=np.int64)
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        first, held = k, 0
        while k < len(texts) and (held == 0 or held + len(texts[k]) < SLICE):
            held += len(texts[k]) + 1
            k += 1
        data = b"\n".join(texts[first:k])
        if lower:
            data = data.translate(_LOWER)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[first:k])])
        at = 0
        while at < len(data):
            end = min(len(data), at + SLICE)
            if end < len(data):  # cut at white space; a longer word is taken whole
                while end < len(data) and not _SPACE[data[end]]:
                    end += 1
            starts, hashes = _slice_hashes(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at))
            out.append(hashes)
            counts[first:k] += np.diff(np.searchsorted(starts + at, offsets))
            at = end
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def windows(words: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """Hash of each window of ``length`` words; ``kind`` 0 or 1 gives independent hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASES[1] if kind == 0 else _BASES[2]
    if length > LONG_WINDOW:
        half = -(-length // 2)
        halves = windows(words, half, kind)
        return mixed(mixed(halves[:n] * np.uint64(base)) + halves[length - half :])
    own = words if kind == 0 else mixed(words ^ np.uint64(_BASES[0]))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(own * powers(base, len(words)), out=sums[1:])
    del own
    spans = sums[length:] - sums[:-length]
    del sums
    spans *= powers(_inverse(base), n)
    return mixed(spans)
