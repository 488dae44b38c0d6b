"""The draws of ``resample.draw`` by numpy: the first 32 bits of md5(seed:rep:i), for many at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

#: Draws that are worked on at a time, so that their arrays stay in a core's cache.
BLOCK = 16_384
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ADDED = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
TURNED = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
WORD = [*range(16), *[(5 * k + 1) % 16 for k in range(16)], *[(3 * k + 5) % 16 for k in range(16)], *[7 * k % 16 for k in range(16)]]


def same_length(low: int, high: int) -> Iterator[tuple[int, int]]:
    """low..high-1 cut where the number of decimal digits changes."""
    while low < high:
        end = min(high, 10 ** len(str(low)))
        yield low, end
        low = end


def digest(words: list, shape: tuple[int, int]) -> np.ndarray:
    """First four bytes, the first one highest, of the MD5 of one block of 16 words (numbers or arrays)."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        w = words[WORD[k]]
        if isinstance(w, int):
            f += np.uint32((ADDED[k] + w) & 0xFFFFFFFF)
        else:
            f += w
            f += np.uint32(ADDED[k])
        turn = TURNED[k // 16][k % 4]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(START[0])
    return a.byteswap()


def block(seed: bytes, reps: tuple[int, int], items: tuple[int, int]) -> np.ndarray:
    """Hashes (reps, items) of numbers with as many digits each."""
    shape = (reps[1] - reps[0], items[1] - items[0])
    length = len(seed) + len(str(reps[0])) + len(str(items[0])) + 2
    if length > 55:
        one = lambda r, i: int.from_bytes(hashlib.md5(b"%b:%d:%d" % (seed, r, i)).digest()[:4], "big")
        return np.array([[one(r, i) for i in range(*items)] for r in range(*reps)], np.uint32)

    def digits(span: tuple[int, int], at: tuple[int, int]) -> list:
        values = np.arange(*span, dtype=np.int64).reshape(at)
        each = []
        for p in reversed(range(len(str(span[0])))):
            low, high = span[0] // 10**p, (span[1] - 1) // 10**p
            each.append(low % 10 + 48 if low == high else (values // 10**p % 10 + 48).astype(np.uint32))
        return each

    text = [*seed, 58, *digits(reps, (-1, 1)), 58, *digits(items, (1, -1)), 128]
    words: list = [0] * 16
    for k, x in enumerate(text):
        shift = 8 * (k % 4)
        words[k // 4] = words[k // 4] + (x << shift if isinstance(x, int) else x << np.uint32(shift))
    words[14] = 8 * length
    words = [w if isinstance(w, int) else np.ascontiguousarray(np.broadcast_to(w, shape)) for w in words]
    return digest(words, shape)


def picks(seed: str, low: int, high: int, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """All draws of repetitions low..high-1 as (first, end, places): an array of repetitions by draws, in 0..n-1, block by block."""
    width = min(n, BLOCK)
    tall = max(1, BLOCK // width)
    for r0, r1 in same_length(low, high):
        for r in range(r0, r1, tall):
            for i0, i1 in same_length(0, n):
                for i in range(i0, i1, width):
                    end = min(r1, r + tall)
                    h = block(seed.encode(), (r, end), (i, min(i1, i + width)))
                    yield r, end, (h if n > 0xFFFFFFFF else h % np.uint32(n)).astype(np.int64)


def means(values: np.ndarray, seed: str, low: int, high: int) -> np.ndarray:
    """The mean of as many drawn values as there are, for each repetition."""
    out = np.zeros(high - low)
    for r, end, at in picks(seed, low, high, len(values)):
        out[r - low:end - low] += values[at].sum(axis=1)
    return out / len(values)


def times(seed: str, rep: int, n: int) -> np.ndarray:
    """How often each of n is drawn in one repetition."""
    out = np.zeros(n, np.uint32)
    for _, _, at in picks(seed, rep, rep + 1, n):
        np.add.at(out, at.ravel(), np.uint32(1))
    return out
