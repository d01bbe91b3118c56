"""Global alignment of two texts, and fusion of two transcriptions by confidence. The recurrence has no Catalyst form, so these are Arrow-batched Python functions.

align() and fuse() are the forms for one pair; columns go by align_many(), which gives the same for many pairs at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def align(a: str, b: str) -> list[tuple[str | None, str | None]]:
    """Pairs of characters, None for a gap. Match 1, mismatch and gap -1; going back, the diagonal is preferred, then a gap in b.

    Row by row in NumPy: the dependence along a row is a running maximum of (cell without left neighbour) + column.
    """
    n, m = len(a), len(b)
    codes = np.array([ord(c) for c in b], np.int64)
    columns = np.arange(m + 1)
    score = np.empty((n + 1, m + 1), np.int32)
    score[0] = -columns
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int64)
        best[0] = -i
        best[1:] = np.maximum(score[i - 1, :-1] + np.where(codes == ord(a[i - 1]), 1, -1), score[i - 1, 1:] - 1)
        score[i] = np.maximum.accumulate(best + columns) - columns
    pairs: list[tuple[str | None, str | None]] = []
    i, j = n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            pairs.append((a[i], b[j]))
        elif i and score[i, j] == score[i - 1, j] - 1:
            i -= 1
            pairs.append((a[i], None))
        else:
            j -= 1
            pairs.append((None, b[j]))
    return pairs[::-1]


def fuse(a: str, a_confidences: list[float], b: str, b_confidences: list[float]) -> tuple[str, list[float]]:
    """At a gap the other side's character, else the more confident one (a at a tie). A gap's side must have a confidence, elsewhere a missing one counts as 0."""
    text, confidences, i, j = [], [], 0, 0
    for x, y in align(a, b):
        p = None if x is None else a_confidences[i] if y is None or i < len(a_confidences) else 0.0
        q = None if y is None else b_confidences[j] if x is None or j < len(b_confidences) else 0.0
        take_a = q is None or (p is not None and p >= q)
        text.append(x if take_a else y)
        confidences.append(float(p if take_a else q))
        i, j = i + (x is not None), j + (y is not None)
    return "".join(text), confidences


#: What align_many() writes for a pair of characters, a character of a only, and one of b only; cells of a batch; the first band's margin.
BOTH, ONLY_A, ONLY_B = 0, 1, 2
CELLS, MARGIN = 4_000_000, 4
_NONE = -(1 << 28)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.int32)


def _banded(a: list[np.ndarray], b: list[np.ndarray], margin: int) -> list[np.ndarray | None]:
    """The steps of each pair within a band about the diagonals from start to end; None where a path outside of it may score as well."""
    rows, n, m = np.arange(len(a)), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    low, high, wide = np.minimum(0, m - n) - margin, int(n.max()), int(np.abs(m - n).max()) + 2 * margin + 1
    # of_b[r, x] is b's character x + low, so that a row of the band is a slice.
    of_a, of_b = np.full((len(a), high), -1, np.int32), np.full((len(a), high + wide), -2, np.int32)
    for r, (x, y) in enumerate(zip(a, b)):
        of_a[r, : len(x)] = x
        cut = y[: max(0, high + wide + low[r])]
        of_b[r, -low[r] : -low[r] + len(cut)] = cut
    columns = np.arange(wide, dtype=np.int32)
    score = np.empty((high + 1, len(a), wide), np.int32)
    j = low[:, None] + columns
    score[0] = np.where(j >= 0, -j, _NONE)
    for i in range(1, high + 1):
        best = score[i - 1] + np.where(of_b[:, i - 1 : i - 1 + wide] == of_a[:, i - 1 : i], np.int32(1), np.int32(-1))
        np.maximum(best[:, :-1], score[i - 1][:, 1:] - 1, out=best[:, :-1])
        score[i] = np.maximum.accumulate(best + columns, axis=1) - columns
    # 4 a mismatch and 3 a gap; a path outside has the gaps to get there and back.
    cost = n + m - 2 * score[n, rows, m - n - low]
    sure = (cost < 3 * (np.abs(m - n) + 2 * margin + 2)) | (margin >= np.maximum(n, m))
    steps, lengths = np.zeros((len(a), int((n + m).max()) if len(a) else 0), np.uint8), np.zeros(len(a), np.int64)
    r = rows[sure & (n + m > 0)]
    i, j, at = n[r], m[r], 0
    while len(r):
        t = j - i - low[r]
        now, above = score[i, r, t], np.maximum(i - 1, 0)
        alike = of_a[r, above] == of_b[r, np.maximum(i + t - 1, 0)] if high else np.zeros(len(r), bool)
        both = (i > 0) & (j > 0) & (now == score[above, r, t] + np.where(alike, 1, -1))
        only_a = ~both & (i > 0) & (t + 1 < wide) & (now == score[above, r, np.minimum(t + 1, wide - 1)] - 1)
        steps[r, at] = np.where(both, BOTH, np.where(only_a, ONLY_A, ONLY_B))
        i, j, at = i - (both | only_a), j - ~only_a, at + 1
        done = (i == 0) & (j == 0)
        if done.any():
            lengths[r[done]] = at
            r, i, j = r[~done], i[~done], j[~done]
    return [steps[r, : lengths[r]][::-1] if sure[r] else None for r in rows]


def align_many(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """align()'s steps of each pair of texts (as code points): tables of many pairs are filled together, first in a narrow band, and anew in a wider one where that isn't sure to hold all best paths."""
    out: list = [np.zeros(len(x), np.uint8) if np.array_equal(x, y) else None for x, y in zip(a, b)]
    margin = MARGIN
    while open_ := sorted((k for k, x in enumerate(out) if x is None), key=lambda k: (abs(len(a[k]) - len(b[k])) // 8, len(a[k]))):
        while open_:
            # From the end on: the longest of those left, with whom the batch is measured.
            some, cells, wide = [], 0, 0
            high = len(a[open_[-1]])
            while open_ and (not some or cells <= CELLS):
                k = open_.pop()
                some.append(k)
                wide, high = max(wide, abs(len(a[k]) - len(b[k])) + 2 * margin + 1), max(high, len(a[k]))
                cells = (len(some) + 1) * wide * (high + 1)
            for k, found in zip(some, _banded([a[k] for k in some], [b[k] for k in some], margin)):
                out[k] = found
        margin *= 4
    return out


def _paths(x: pa.Array, y: pa.Array) -> tuple:
    """(texts, code points of each, steps joined, rows' offsets) of two string columns; null is empty."""
    texts = [[s or "" for s in c.to_pylist()] for c in (x, y)]
    codes = [[_codes(s) for s in c] for c in texts]
    steps = align_many(*codes)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in steps])]).astype(np.int32)
    joined = [np.concatenate([*c, np.zeros(0, np.int32)]).astype(np.int32) for c in codes]
    return texts, joined, codes, np.concatenate([*steps, np.zeros(0, np.uint8)]), offsets


def _utf8_lengths(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)


def _characters(text: list[str], codes: np.ndarray, used: np.ndarray) -> pa.Array:
    """A string a step: the texts' next character where used, else null."""
    sizes = np.zeros(len(used) + 1, np.int32)
    sizes[1:][used] = _utf8_lengths(codes)
    return pa.StringArray.from_buffers(len(used), pa.py_buffer(np.cumsum(sizes, dtype=np.int32)), pa.py_buffer("".join(text).encode()), pa.py_buffer(np.packbits(used, bitorder="little")))


def alignment(a: Column, b: Column) -> Column:
    """Array of (a, b) characters, null for a gap."""

    @F.arrow_udf("array<struct<a:string,b:string>>")
    def aligned(x: pa.Array, y: pa.Array) -> pa.Array:
        texts, joined, _, steps, offsets = _paths(x, y)
        pairs = [_characters(texts[k], joined[k], steps != gap) for k, gap in ((0, ONLY_B), (1, ONLY_A))]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(pairs, names=["a", "b"]))

    return aligned(a, b)


def _confidences(given: pa.Array, codes: list[np.ndarray], used: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """The confidence at each step, NaN where the side has a gap; see fuse()."""
    if given.null_count:
        raise TypeError("a text has no confidences")
    sizes, values = given.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), given.flatten().to_numpy(zero_copy_only=False).astype(float)
    lengths = np.array([len(c) for c in codes], np.int64)
    row = np.repeat(np.arange(len(codes)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    known = place < sizes[row]
    if (~known & alone[used]).any():
        raise IndexError("a gap's side has no confidence")
    of = np.zeros(len(row))
    of[known] = values[((np.cumsum(sizes) - sizes)[row] + place)[known]]
    out = np.full(len(used), np.nan)
    out[used] = of
    return out


def fusion(a: Column, a_confidences: Column, b: Column, b_confidences: Column) -> Column:
    """(text, confidences) of two transcriptions, as fuse() does it."""

    @F.arrow_udf("struct<text:string,confidences:array<double>>")
    def fused(x: pa.Array, p: pa.Array, y: pa.Array, q: pa.Array) -> pa.Array:
        _, joined, codes, steps, offsets = _paths(x, y)
        of_a, of_b = steps != ONLY_B, steps != ONLY_A
        ps, qs = _confidences(p, codes[0], of_a, steps == ONLY_A), _confidences(q, codes[1], of_b, steps == ONLY_B)
        take_a = ~of_b | (of_a & (ps >= qs))
        chosen = np.zeros(len(steps), np.int32)
        chosen[of_b] = joined[1]
        both = np.zeros(len(steps), np.int32)
        both[of_a] = joined[0]
        chosen = np.where(take_a, both, chosen).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(_utf8_lengths(chosen))]).astype(np.int32)
        text = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets]), pa.py_buffer(chosen.tobytes().decode("utf-32-le").encode()))
        return pa.StructArray.from_arrays([text, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.where(take_a, ps, qs)))], names=["text", "confidences"])

    return fused(a, a_confidences, b, b_confidences)
