"""MD5 of many short texts at once: texts that differ in their first characters, as hash draws do, in NumPy. One digest takes some 0.2 µs instead of the 1 µs and more of a column expression with its texts."""

from __future__ import annotations

import math

import numpy as np

ROUNDS = tuple(int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64))
TURNS = tuple(t for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in row * 4)
WORDS = tuple((i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64))
_LEFT, _RIGHT, _ROUNDS = ([np.uint32(x) for x in xs] for xs in (TURNS, [32 - t for t in TURNS], ROUNDS))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def blocks(tails: list[bytes], prefix: int) -> list[list[np.ndarray | int]]:
    """The 16 words of each block of texts with a prefix of so many bytes left open; a word that all have alike is one number. All texts must fill the same number of blocks."""
    lengths = np.array([len(t) for t in tails], np.int64) + prefix
    n = int(lengths[0] + 8) // 64 + 1
    # The 1 after a text's end also keeps its own zeros from being cut.
    whole = np.zeros((len(tails), 64 * n), np.uint8)
    joined = np.array([t + b"\x80" for t in tails])
    whole[:, prefix : prefix + joined.itemsize] = joined.view(np.uint8).reshape(len(tails), -1)
    whole[:, -8:] = (8 * lengths).astype("<u8").view(np.uint8).reshape(-1, 8)
    words = np.ascontiguousarray(whole.view("<u4").T)
    same = (words == words[:, :1]).all(axis=1)
    return [[int(words[k, 0]) if same[k] else words[k] for k in range(16 * b, 16 * b + 16)] for b in range(n)]


def n_blocks(length: int) -> int:
    return (length + 8) // 64 + 1


def digests(parts: list[list[np.ndarray | int]], prefix: bytes, count: int) -> tuple[np.ndarray, ...]:
    """The digests' four little-endian words, of blocks() with the prefix put in."""
    given = np.frombuffer(prefix + bytes(64 - len(prefix)), "<u4").tolist()
    state: list = [np.full(count, s, np.uint32) for s in START]
    f, t = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for nth, words in enumerate(parts):
        if nth == 0:
            words = [(w | g if isinstance(w, int) else w | np.uint32(g)) if g else w for w, g in zip(words, given)]
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            if i < 16:  # d ^ (b & (c ^ d))
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:  # c ^ (d & (b ^ c))
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            w = words[WORDS[i]]
            np.add(a, f, out=a)
            if isinstance(w, int):
                np.add(a, np.uint32((ROUNDS[i] + w) & 0xFFFFFFFF), out=a)
            else:
                np.add(a, w, out=a)
                np.add(a, _ROUNDS[i], out=a)
            np.left_shift(a, _LEFT[i], out=t)
            np.right_shift(a, _RIGHT[i], out=a)
            np.bitwise_or(a, t, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        state = [s + x for s, x in zip(state, (a, b, c, d))]
    return tuple(state)


def leading(words: tuple[np.ndarray, ...], digits: int, start: int = 0) -> np.ndarray:
    """So many hex digits of each digest from a place on, 16 at most, as numbers."""
    first, last = start // 8, (start + digits - 1) // 8
    out = words[first].byteswap().astype(np.uint64) & np.uint64((1 << 4 * (8 * first + 8 - start)) - 1)
    for k in range(first + 1, last + 1):
        out = (out << np.uint64(32)) | words[k].byteswap()
    return out >> np.uint64(4 * (8 * last + 8 - start - digits))
