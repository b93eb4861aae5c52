"""Word codes, occurrence-labelled k-mers, Order MinHash sketches and banded alignment (numpy, one text at a time)."""

from __future__ import annotations

import numpy as np
import xxhash

_CACHE_LIMIT = 400_000


class _Hashes(dict):
    """Word -> the eight bytes of its hash."""

    def __missing__(self, word: str) -> bytes:
        code = self[word] = xxhash.xxh64_digest(word)
        return code


_hashes = _Hashes()
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: str | None) -> np.ndarray:
    """64-bit hashes of the white-space separated words of a text; null counts as empty."""
    if len(_hashes) > _CACHE_LIMIT:
        _hashes.clear()
    return np.frombuffer(b"".join(map(_hashes.__getitem__, (text or "").split())), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _kmers(codes: np.ndarray, k: int) -> np.ndarray:
    n = len(codes)
    k = min(k, n)
    grams = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        grams = (grams * _GOLDEN) ^ _mix(codes[i : n - k + 1 + i] + np.uint64(i + 1))
    return _mix(grams)


def repeated(codes: np.ndarray, k: int) -> np.ndarray:
    """Which k-mers of a text of at least one word stand further back in it already."""
    grams = _kmers(codes, k)
    again = np.ones(len(grams), dtype=bool)
    again[np.unique(grams, return_index=True)[1]] = False
    return again


def labelled_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """One hash per k-mer in text order; equal k-mers of one text differ by their occurrence number.

    A text of fewer than k words is one k-mer of all its words, an empty text has none.
    """
    if len(codes) == 0:
        return codes
    grams = _kmers(codes, k)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    fresh = np.empty(len(ranked), dtype=bool)
    fresh[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    if not fresh.all():
        at = np.arange(len(ranked))
        starts = np.maximum.accumulate(np.where(fresh, at, 0))
        again = at > starts  # a first occurrence keeps its hash, as in texts without repeats
        grams[order[again]] = _mix(ranked[again] + (at - starts)[again].astype(np.uint64) * _GOLDEN)
    return grams


def sketch_seeds(sketches: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, sketches, dtype=np.uint32), rng.integers(0, 2**31, sketches, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def order_minhash(codes: np.ndarray, k: int, picks: int, seeds: tuple[np.ndarray, np.ndarray], first: int = 0, once: bool = False) -> np.ndarray:
    """One signed 64-bit key for each sketch: its `picks` smallest labelled k-mers, hashed in the order they have in the text.

    Sketches are numbered from `first`; those of different numbers are never equal but by chance.  once: of the first occurrences alone; none for
    a text that repeats no k-mer, as they would be the same."""
    grams = labelled_kmers(codes, k)
    if once:
        again = repeated(codes, k)
        if not again.any():
            return np.empty(0, np.int64)
        grams = grams[~again]
    xors, odds = seeds
    keys = np.zeros(len(xors), dtype=np.uint64)
    if len(grams) == 0:
        return keys.view(np.int64)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    step = max(1, 4_000_000 // len(low))
    rows_picked = min(picks, len(low))
    for at in range(0, len(xors), step):
        values = (low[None, :] ^ xors[at : at + step, None]) * odds[at : at + step, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        rows = np.arange(len(values))
        chosen = np.empty((len(values), rows_picked), dtype=np.int64)
        for p in range(rows_picked):
            chosen[:, p] = values.argmin(axis=1)
            values[rows, chosen[:, p]] = np.uint32(0xFFFFFFFF)
        chosen.sort(axis=1)
        key = np.full(len(values), 1 + first, dtype=np.uint64) + np.arange(at, at + len(values), dtype=np.uint64)
        for p in range(rows_picked):
            key = _mix((key * _GOLDEN) ^ grams[chosen[:, p]])
        keys[at : at + step] = key
    return keys.view(np.int64)


def band_width(n: int, m: int, similarity: float) -> int:
    """Largest edit distance at which two texts of n and m words still have the similarity 1 - distance / longer length."""
    return int(np.floor((1.0 - similarity) * max(n, m) + 1e-9))


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edit distance of two code sequences if it is at most `band`, else None.

    Only cells within `band` of the diagonal are followed, a column of them at a time as the bits of one integer (the bit-vector algorithms of
    Myers 1999 and, for the band, of Hyyro 2003).
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    if short:
        differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
        tail = int(differ[0]) if len(differ) else short
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return max(n, m) if max(n, m) <= band else None
    if max(n, m) - _shared(a, b) > band:
        return None
    rows, places = {}, a.tolist()
    for i, word in enumerate(places):
        rows[word] = rows.get(word, 0) | 1 << i
    found = _whole_columns(rows, n, b.tolist()) if n <= 2 * band + 1 else _band_columns(rows, n, b.tolist(), band)
    return found if found is not None and found <= band else None


def _whole_columns(rows: dict[int, int], n: int, b: list[int]) -> int:
    """Distance of n words, given by the bits of their places, from the words b; `up` and `down` are the steps of +1 and -1 along a column."""
    whole, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = whole, 0, n
    for word in b:
        same = rows.get(word, 0) | down
        free = (((same & up) + up) ^ up) | same
        right, left = (down | ~(free | up)) & whole, free & up
        distance += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(free | right)) & whole, right & free & whole
    return distance


def _band_columns(rows: dict[int, int], n: int, b: list[int], band: int) -> int | None:
    """As _whole_columns, for columns cut to 2 * band + 1 cells around the diagonal, which move down by one with each word; None once the distance
    is above the band for certain."""
    width = 2 * band + 1
    whole, last = (1 << width) - 1, 1 << (width - 1)
    up, down, distance = whole ^ ((1 << band) - 1), 0, band
    for j, word in enumerate(b, 1):
        held, shift = rows.get(word, 0), j - band - 1
        same = (held >> shift if shift >= 0 else held << -shift) & whole
        free = (((same & up) + up) ^ up) | same | down
        right, left = (down | ~(free | up)) & whole, free & up
        if j + band <= n:  # the lowest cell of the band is in the table: down its diagonal
            distance += not free & last
        else:  # along the last row
            place = 1 << (n - j + band)
            distance += bool(right & place) - bool(left & place)
        if distance - (len(b) - j) > band and j + band >= n:
            return None
        free >>= 1
        up, down = (left | ~(free | right)) & whole, free & right
    return distance


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two sequences have in common, with multiplicity."""
    values, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    inverse = inverse.reshape(-1)
    return int(np.minimum(np.bincount(inverse[: len(a)], minlength=len(values)), np.bincount(inverse[len(a) :], minlength=len(values))).sum())
