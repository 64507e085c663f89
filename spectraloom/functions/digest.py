"""Poisson weights of bootstrap replicates, from the MD5 digest of ``seed:replicate:row``, for all replicates of a row at once.

The digest of one block is 64 steps of 32-bit arithmetic, here on arrays with an entry for each replicate.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: 2**32 times the distribution function of Poisson(1) at 0, 1, ..
POISSON_CUTS = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8)]
#: Bytes of a message that fit one block beside the padding.
ONE_BLOCK = 55

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_WORD = [*range(16), *((5 * k + 1) % 16 for k in range(16)), *((3 * k + 5) % 16 for k in range(16)), *(7 * k % 16 for k in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_words(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first eight hex digits, as numbers, of the digests of ``n`` one-block messages; ``words[k]`` is the k-th 32-bit word of all of them, or a number they share."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[_WORD[k]]
        np.add(a, f, out=a)
        if isinstance(w, np.ndarray):
            np.add(a, w, out=a)
            w = 0
        np.add(a, np.uint32((_SINES[k] + w) & 0xFFFFFFFF), out=a)
        np.right_shift(a, np.uint32(32 - _SHIFTS[k]), out=t)
        np.left_shift(a, np.uint32(_SHIFTS[k]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + np.uint32(_START[0])).byteswap()


class Weights:
    """The weights of rows in replicates 0 to ``reps - 1``."""

    def __init__(self, reps: int, seed: int) -> None:
        self.heads = [f"{seed}:{k}".encode() for k in range(reps)]
        sizes = np.array([len(h) for h in self.heads])
        # replicates whose numbers have as many digits stand side by side
        self.runs = [(int(np.searchsorted(sizes, s)), int(np.searchsorted(sizes, s, "right")), int(s)) for s in np.unique(sizes)]
        self.base = np.zeros((16, reps, 4), np.uint8)
        for lo, hi, s in self.runs:
            heads = np.frombuffer(b"".join(self.heads[lo:hi]), np.uint8).reshape(hi - lo, s)
            for p in range(min(s, ONE_BLOCK)):
                self.base[p // 4, lo:hi, p % 4] = heads[:, p]

    def of(self, row: str | None) -> np.ndarray:
        """An 8-bit weight for each replicate; a row without a name is named by the replicate alone."""
        tail = b"" if row is None else b":" + row.encode()
        if len(self.heads[-1]) + len(tail) > ONE_BLOCK:
            u = np.array([int.from_bytes(hashlib.md5(h + tail, usedforsecurity=False).digest()[:4], "big") for h in self.heads], np.uint32)
        else:
            block, n = self.base.copy(), len(self.heads)
            for lo, hi, s in self.runs:
                for p, byte in enumerate(tail + b"\x80", s):
                    block[p // 4, lo:hi, p % 4] = byte
            words = block.view("<u4")[:, :, 0]
            for lo, hi, s in self.runs:
                words[14, lo:hi] = 8 * (s + len(tail))
            u = first_words([int(w[0]) if (w == w[0]).all() else w for w in words], n)
        out = np.zeros(len(u), np.uint8)
        for cut in POISSON_CUTS:
            out += u >= np.uint32(cut)
        return out
