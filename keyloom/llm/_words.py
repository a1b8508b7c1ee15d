"""Words of many documents at once, as numpy arrays over one byte buffer.

A word is a maximal run of bytes outside space and tab to carriage return, which in UTF-8 is the same
as ``[^\\x20\\x09-\\x0D]+`` over code points. Hashes are polynomials modulo 2**64 over random byte
values: with prefix sums, the hash of any range of bytes or words costs two look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
BYTE_VALUES = np.random.default_rng(20240117).integers(1, 2**64, 256, dtype=U64)
TOP = U64(2**64 - 1)
#: Bytes or words that are hashed at once; results don't depend on it.
STRETCH = 1 << 17
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    known = _powers.get(base)
    if known is None or len(known[0]) <= n:
        size = max(n + 1, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, U64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=U64))
        known = (made[0], made[1])
        if size <= 1 << 22:  # what one very long document needs isn't kept
            _powers[base] = known
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole value."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same wherever the range lies."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def long_hash(values: np.ndarray, base: int = BASES[0]) -> int:
    """ranges_hash of all the values, stretch by stretch."""
    total = 0
    for low in range(0, len(values), STRETCH):
        part = BYTE_VALUES[values[low : low + STRETCH]]
        total += int((part * powers(STRETCH, base)[0][: len(part)]).sum(dtype=U64)) * pow(base, low, 2**64)
    return total % 2**64


def slide(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """out[i] = pick over a[i : i + width], or as far as a goes."""
    out, span = a.copy(), 1
    while span * 2 <= width:
        out[:-span] = pick(out[:-span], out[span:])
        span *= 2
    if rest := width - span:
        out[:-rest] = pick(out[:-rest], out[rest:])
    return out


class Words:
    """starts, ends: of each word in buffer; first: index of each document's first word, and the count at the end.

    Besides the buffer it holds about 16 bytes a word; what is derived from bytes is made stretch by stretch, so that
    one very long text needs some ten times its size, not more.
    """

    def __init__(self, texts: list[bytes], translate: bytes | None = None):
        joined = b" " + b" ".join(texts) + b" "
        self.buffer = joined.translate(translate) if translate else joined
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        edges = []
        for low in range(0, len(self.bytes) - 1, STRETCH):
            space = IS_SPACE[self.bytes[low : low + STRETCH + 1]]
            edges.append(np.flatnonzero(space[1:] != space[:-1]) + (low + 1))
        edges = np.concatenate(edges)
        self.starts, self.ends = edges[0::2], edges[1::2]
        begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.begin = begin
        self.first = np.searchsorted(self.starts, begin)
        self.n = len(self.starts)

    def hashes(self) -> np.ndarray:
        out = np.empty(self.n, U64)
        groups = np.unique(np.searchsorted(self.starts, np.arange(0, len(self.bytes) + STRETCH, STRETCH)))
        for i, j in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            low, last = int(self.starts[i]), j
            if self.ends[j - 1] - low > 4 * STRETCH:  # only a group's last word reaches beyond its stretch
                last = j - 1
                out[last] = long_hash(self.bytes[self.starts[last] : self.ends[last]])
            if last > i:
                values = BYTE_VALUES[self.bytes[low : self.ends[last - 1]]]
                out[i:last] = ranges_hash(values, self.starts[i:last] - low, self.ends[i:last] - low)
        out += (self.ends - self.starts).astype(U64) * U64(BASES[1])
        return mix(out)

    def docs(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(self.n)

    def of(self, doc: int) -> list[bytes]:
        return self.buffer[self.begin[doc] : self.begin[doc + 1]].split()


def grams(hashes: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 entries are missing."""
    out = np.empty(max(0, len(hashes) - k + 1), U64)
    for low in range(0, len(out), STRETCH):
        at = np.arange(min(STRETCH, len(out) - low))
        out[low : low + STRETCH] = ranges_hash(hashes[low : low + len(at) + k - 1], at, at + k, base)
    return out


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def stretches(text: bytes, overlap: int, size: int = 1 << 20) -> Iterator[bytes]:
    """Runs of whole words, of about size bytes, that make up the text; each begins with the last words of those before, overlap of them."""
    if len(text) <= 2 * size:
        yield text
        return
    low, tail = 0, b""
    while low < len(text):
        gap = _GAP.search(text, low + size)
        high = gap.start() if gap else len(text)
        part = tail + text[low:high]
        yield part
        tail = b"".join(w + b" " for w in part.rsplit(None, overlap)[-overlap:]) if overlap else b""
        low = high
