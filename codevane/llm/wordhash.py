"""Words of a column of texts as arrays of 64-bit hashes.

A word is a run of bytes other than space and the controls 9 to 13.  A word's
hash is a polynomial of its bytes modulo 2**61 - 1, taken from running sums
over a whole block, so a block costs a few passes of array arithmetic and no
loop over words.  Equal words have equal hashes in every process; two unlike
words of n bytes have the same in about n of 2**61 cases.

A null text counts as empty and has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is cut between words.
BLOCK = 1 << 20
#: A longer word's sums are taken in parts.
LONG = 1 << 22

#: Hashes are polynomials over the field of this prime, so no pattern of letters makes unlike words meet.
PRIME = (1 << 61) - 1
_BASE = 0x0F1E2D3C4B5A6978
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _LOW = np.uint64(PRIME), np.uint64((1 << 30) - 1)
_powers: list[np.ndarray] = []


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**63 modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times_power(x: np.ndarray, bits: int) -> np.ndarray:
    """x * 2**bits modulo PRIME, for x below PRIME: its 61 bits turned round."""
    return ((x << np.uint64(bits)) & _P) | (x >> np.uint64(61 - bits))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for numbers below PRIME."""
    a1, a0 = a >> np.uint64(30), a & _LOW
    b1, b0 = b >> np.uint64(30), b & _LOW
    middle = _reduced(a1 * b0 + a0 * b1)
    return _reduced(_reduced(_times_power(_reduced(a1 * b1), 60) + _times_power(middle, 30)) + _reduced(a0 * b0))


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2**30 + low modulo PRIME, for numbers below 2**62."""
    return _reduced(_times_power(_reduced(high), 30) + _reduced(low))


def _tables(n: int) -> tuple[np.ndarray, ...]:
    """The high and low parts of the first n powers of the base, and the powers of its inverse."""
    if not _powers or len(_powers[0]) < n:
        found = []
        for base in (_BASE, pow(_BASE, -1, PRIME)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, product(p, np.uint64(pow(base, len(p), PRIME)))])
            found.append(p)
        _powers[:] = [found[0] >> np.uint64(30), found[0] & _LOW, found[1]]
    return tuple(_powers)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _split(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf; no word crosses one of the cuts."""
    space = _SPACE[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[1:] != space[:-1]
    edge[cuts] = True
    at = np.flatnonzero(edge)
    keep = ~space[at[:-1]] if len(buf) else np.zeros(0, bool)
    return at[:-1][keep], at[1:][keep]


def _long(word: np.ndarray, high: np.ndarray, low: np.ndarray) -> int:
    """The polynomial of a word of any length."""
    total = 0
    for a in range(0, len(word), LONG):
        byte = word[a : a + LONG].astype(np.uint64) + np.uint64(1)
        part = (int((byte * high[: len(byte)]).sum()) << 30) + int((byte * low[: len(byte)]).sum())
        total += part * pow(_BASE, a, PRIME)
    return total % PRIME


def _hash(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    high, low, inverse = _tables(len(buf) + 1)
    byte, sums = buf.astype(np.uint64) + np.uint64(1), []
    for power in (high, low):
        s = np.zeros(len(buf) + 1, np.uint64)
        # sums go round at 2**64; the products of LONG bytes, at most 2**40 each, stay below that
        np.cumsum(byte * power[: len(buf)], out=s[1:])
        sums.append(s[en] - s[st])
    value = product(joined(*sums), inverse[st])
    for i in np.flatnonzero(en - st > LONG):
        value[i] = _long(buf[st[i] : en[i]], high, low)
    return mix(value + (en - st).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Block:
    """Words of the documents lo to hi-1 of a batch: document d's are hash[at[d - lo]:at[d - lo + 1]]."""

    lo: int
    hi: int
    at: np.ndarray
    hash: np.ndarray
    start: np.ndarray | None = None
    end: np.ndarray | None = None
    buf: np.ndarray | None = None


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(texts: pa.Array, lower: bool = False, spans: bool = False, block: int = BLOCK) -> Iterator[Block]:
    """The words of a batch of texts, about ``block`` bytes at a time, whole texts together.

    ``lower`` lowers A-Z.  ``spans`` adds each word's start and end in ``buf``.
    """
    off, data = buffers(texts)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block, "right")) - 1)
        buf = data[off[lo] : off[hi]]
        if lower:
            buf = _LOWER[buf]
        cuts = off[lo : hi + 1] - off[lo]
        if len(buf) <= 2 * block:
            st, en = _split(buf, cuts)
            h = _hash(buf, st, en)
        else:
            st, en = _split(buf, cuts)
            parts, a = [], 0
            while a < len(st):
                b = max(a + 1, int(np.searchsorted(en, st[a] + block, "right")))
                parts.append(_hash(buf[st[a] : en[b - 1]], st[a:b] - st[a], en[a:b] - st[a]))
                a = b
            h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        at = np.searchsorted(st, cuts)
        yield Block(lo, hi, at, h, *((st, en, buf) if spans else ()))
        lo = hi


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words of an array of word hashes, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def same_document(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n - k + 1 runs of k words, whether all its words are of one document."""
    m = max(0, n - k + 1)
    ok = np.ones(m, bool)
    for i in range(1, k):
        b = at[1:-1] - i
        ok[b[(b >= 0) & (b < m)]] = False
    return ok
