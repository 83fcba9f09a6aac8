"""64-bit hashes of all words of many texts at once, with numpy.

A word's hash is a polynomial of its bytes modulo 2^64, taken from a running sum over the whole stretch of
text and brought to the word's start, then mixed. It depends on the word alone, not on the task, the
batch or the place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

U64 = np.uint64
#: Bytes that are worked on at once; a document isn't cut before a separator.
STRETCH = 1 << 20
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """stream: 0 or 1, for independent hashes. unchanged: words are runs without ASCII white space, as they
    stand; else runs of ASCII letters and digits and of bytes from 128, in lower case."""

    def __init__(self, unchanged: bool = False, stream: int = 0):
        self.unchanged = unchanged
        base = _BASE[stream]
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self._value = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019 + 2 * stream))
        code = np.arange(256)
        if unchanged:
            self._word = ~((code == 32) | (code >= 9) & (code <= 13))
        else:
            letters = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
            self._word = np.isin(code, letters)
        self._power = self._back = np.zeros(0, U64)

    def _tables(self, n: int) -> None:
        if len(self._power) < n:
            n = max(n, STRETCH + (1 << 16))
            self._power, self._back = _powers(self._base, n), _powers(self._inverse, n)

    def data(self, texts: list[str | None]) -> tuple[bytes, np.ndarray]:
        """The texts as bytes, a separator after each, and the offsets at which they start."""
        parts = [(t if self.unchanged else t.lower()).encode("utf-8", "replace") if t else b"" for t in texts]
        start = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=start[1:])
        return b"\n".join([*parts, b""]), start

    def _stretches(self, data: bytes) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(data):
            end = min(at + STRETCH, len(data))
            if end < len(data):
                tail = np.flatnonzero(~self._word[np.frombuffer(data, np.uint8, count=end - at, offset=at)])
                if len(tail):
                    end = at + int(tail[-1]) + 1
                else:  # one word longer than a stretch: up to its end
                    while end < len(data) and self._word[data[end]]:
                        end += 1
            yield at, end
            at = end

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
        """Of each word: its hash, its text's index, its first byte and the byte after it; and the bytes."""
        data, start = self.data(texts)
        found = [self._stretch(data, a, b) for a, b in self._stretches(data)]
        h, first, end = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in ((0, U64), (1, np.int64), (2, np.int64)))
        return h, np.searchsorted(start, first, "right") - 1, first, end, data

    def _stretch(self, data: bytes, a: int, b: int):
        self._tables(b - a)
        raw = np.frombuffer(data, np.uint8, count=b - a, offset=a)
        edge = np.diff(self._word[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(b - a + 1, U64)
        np.cumsum(self._value[raw] * self._power[: b - a], out=total[1:])
        h = (total[end] - total[first]) * self._back[first]
        return mix(h + (end - first).astype(U64) * U64(0x9E3779B97F4A7C15)), first + a, end + a


def windows(h: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of one text, and the indexes of their first words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    factor = U64(0xD6E8FEB86659FD93)
    for k in range(width):
        out = out * factor + h[k : k + n]
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    return mix(out[at]), at


def of_sequences(h: np.ndarray, text: np.ndarray, n_texts: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's whole sequence of words, and its number of words; other salts give independent hashes."""
    start = np.searchsorted(text, np.arange(n_texts + 1))
    nth = (np.arange(len(h)) - start[text]).astype(U64)
    if salt:
        h = mix(h ^ U64(salt * 0xA24BAED4963EE407 % (1 << 64)))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h + nth * U64(0x9E3779B97F4A7C15)))))
    n = np.diff(start)
    return mix(total[start[1:]] - total[start[:-1]] + n.astype(U64)), n


def packed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted hashes and a number for each, small: differences and numbers as planes of bytes, compressed."""
    gap = np.diff(h, prepend=U64(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(gap.T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    size = len(raw) // 12
    gap = np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view(U64).ravel()
    return np.cumsum(gap), np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view("<u4").ravel().astype(np.int64)
