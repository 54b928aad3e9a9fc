"""Word hashing in numpy: one pass over a block of texts, no Python work per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that separate words: space and tab to carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Spans of more bytes than this are hashed one by one.
_LONG = 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    held = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(buf) + 1,), dtype="<u8", buffer=held, strides=(1,))


def lane(eight: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes at these places as numbers, 1 to 8 of each."""
    return eight[at] & (_ALL >> (np.uint64(64) - size.astype(np.uint64) * np.uint64(8)))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span that depends on its bytes alone.

    Eight bytes at a time are mixed into the state, for all spans that have so many at once.  Nothing here is linear in
    the bytes, unlike a polynomial over them, whose hashes meet on words that are easily made.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    eight = by_eight(buf)
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _GOLD + np.uint64(1))
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    for at in range(0, _LONG, 8):
        if not len(live):
            break
        part = lane(eight, starts[live] + at, np.minimum(size[live] - at, 8))
        out[live] = mix((out[live] ^ part) * _GOLD)
        live = live[size[live] > at + 8]
    raw = memoryview(buf)
    for k in np.flatnonzero(size > _LONG).tolist():
        digest = hashlib.blake2b(raw[int(starts[k]) : int(ends[k])], digest_size=8).digest()
        out[k] = np.uint64(int.from_bytes(digest, "little"))
    return out


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.ones(len(buf) + 2, dtype=bool)
    np.take(WHITE, buf, out=gap[1:-1])
    edge = gap[1:] != gap[:-1]
    at = np.flatnonzero(edge)
    return at[0::2], at[1::2]


def blocks(texts: Iterable[str | None], at_most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``at_most`` characters together (one text at least): (index of the first, texts)."""
    held: list[str] = []
    first = size = 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > at_most:
            yield first, held
            held, first, size = [], i, 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def hash_words(texts: list[str], lower: bool = True, stems: tuple[int, ...] = ()) -> tuple:
    """Hashes of all words of all texts, and where each text's words begin (one more entry than texts); with ``stems``, also
    for each of these sizes the words that have more bytes, and the hashes of their first so many."""
    raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    starts, ends = word_bounds(buf)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    words = span_hashes(buf, starts, ends)
    if not stems:
        return words, first
    found = []
    for size in stems:
        longer = np.flatnonzero(ends - starts > size)
        found.append((longer, span_hashes(buf, starts[longer], starts[longer] + size)))
    return words, first, found


#: Odd multipliers, one for each place in a run of words.
PLACES = mix(np.arange(1, 65, dtype=np.uint64) * _GOLD) | np.uint64(1)


def runs(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text, in order; a shorter text is one run, an empty one none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    size = min(size, n)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * PLACES[j]
    return mix(total + np.uint64(size))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of ``runs``."""
    out = runs(words, size)
    out.sort()
    keep = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]
