"""MD5 of many short texts at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that fit one block of the digest.
_ROOM = 55
#: Texts that are worked on at once, so that the registers stay in the cache.
_ROWS = 32768


class Tails:
    """Ends of texts, all of one length, that ``leads`` puts after a common start."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.width = texts, len(texts[0])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), self.width)
        self._words: dict[int, list[np.ndarray]] = {}

    def words(self, at: int) -> list[np.ndarray]:
        """Words of the block from the one that holds the first byte, which is byte ``at`` of it; the end is marked."""
        if at not in self._words:
            n = -(-(at + self.width + 1) // 4)
            block = np.zeros((len(self.texts), 4 * n), np.uint8)
            block[:, at : at + self.width] = self.bytes
            block[:, at + self.width] = 0x80
            self._words[at] = list(np.ascontiguousarray(block.view("<u4").T))
        return self._words[at]


def leads(start: bytes, tails: Tails) -> np.ndarray:
    """The first 32 bits of the digest of ``start`` and each tail, as numbers in the order of the digests."""
    size = len(start) + tails.width
    if size > _ROOM:
        return np.array([int.from_bytes(hashlib.md5(start + x).digest()[:4], "big") for x in tails.texts], np.uint32)
    first, at = divmod(len(start), 4)
    out = np.empty(len(tails.texts), np.uint32)
    for row in range(0, len(out), _ROWS):
        message: list[int | np.ndarray] = [int.from_bytes(start[4 * i : 4 * i + 4], "little") for i in range(first)]
        message += [x[row : row + _ROWS] for x in tails.words(at)]
        if at:
            message[first] = message[first] | np.uint32(int.from_bytes(start[4 * first :], "little"))
        message += [0] * (16 - len(message))
        message[14] = 8 * size
        out[row : row + _ROWS] = _digest(message, len(out[row : row + _ROWS]))
    return out


def _digest(message: list[int | np.ndarray], n: int) -> np.ndarray:
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    # the last three steps do not touch the first word
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, t)
            t &= b
            t ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, t)
            t &= d
            t ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, t)
            t ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, t)
            t |= b
            t ^= c
            g = 7 * i % 16
        t += a
        m, more = message[g], _SINES[i]
        if isinstance(m, int):
            more += m
        else:
            t += m
        t += np.uint32(more & 0xFFFFFFFF)
        s = _SHIFTS[i // 16][i % 4]
        np.left_shift(t, np.uint32(s), u)
        t >>= np.uint32(32 - s)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return (b + np.uint32(_START[0])).byteswap()
