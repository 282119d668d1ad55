"""COCO run-length encoding of binary masks: column-major runs that start with zeros, and their ASCII form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def counts_of(rows, firsts, lasts, height: int, width: int) -> list[int]:
    """Run lengths of the mask that has columns first..last set in each given row (intervals of a row are disjoint)."""
    if not len(rows):
        return [height * width]
    rows, firsts, lasts = (np.asarray(x, np.int64) for x in (rows, firsts, lasts))
    c0, r0 = firsts.min(), rows.min()
    steps = np.zeros((lasts.max() - c0 + 2, rows.max() - r0 + 3), np.int8)
    np.add.at(steps, (firsts - c0, rows - r0 + 1), 1)
    np.add.at(steps, (lasts - c0 + 1, rows - r0 + 1), -1)
    mask = np.cumsum(steps, axis=0)[:-1]
    edge = np.diff(mask, axis=1)
    col, row = np.nonzero(edge == 1)
    begins = (col + c0) * height + row + r0
    col, row = np.nonzero(edge == -1)
    ends = (col + c0) * height + row + r0
    joined = begins[1:] == ends[:-1]
    begins, ends = begins[np.concatenate([[True], ~joined])], ends[np.concatenate([~joined, [True]])]
    marks = np.empty(2 * len(begins), np.int64)
    marks[0::2], marks[1::2] = begins, ends
    out = np.diff(marks, prepend=0).tolist()
    rest = height * width - int(ends[-1])
    return out + [rest] if rest else out


def to_string(counts: list[int]) -> str:
    """Differences to the run two before (from the fourth run on), in groups of five bits with a continuation bit."""
    out = []
    for i, n in enumerate(counts):
        x = n - counts[i - 2] if i > 2 else n
        while True:
            low, x = x & 31, x >> 5
            done = x == (-1 if low & 16 else 0)
            out.append(chr((low if done else low | 32) + 48))
            if done:
                break
    return "".join(out)


def run_counts(mask, row, c0, c1, n: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(run lengths, how many each mask has) of masks 0 .. n - 1, given by columns c0..c1 of rows (disjoint within a row).

    Between a row and the next, a sweep along the columns finds where one is set and the other is not: there a run begins
    or ends.  No pixel is laid out, so what is held grows with the outlines.
    """
    wide, deep, whole = width + 1, height + 1, height * width + 1
    above = (mask * deep + row) * wide
    below = above + wide
    ends = [(v + c) * 4 + kind for v, c, kind in ((above, c0, 0), (above, c1 + 1, 1), (below, c0, 2), (below, c1 + 1, 3))]
    events = np.sort(np.concatenate(ends))
    kind, at = events & 3, events >> 2
    lower, upper = (np.cumsum((kind == k).astype(np.int64) - (kind == k + 1)) for k in (0, 2))
    marks = []
    for one, other in ((lower, upper), (upper, lower)):
        k = np.flatnonzero((one > 0) & (other == 0))
        size = at[k + 1] - at[k]
        place = np.repeat(at[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        line, col = np.divmod(place, wide)
        marks.append(np.sort(line // deep * whole + col * height + line % deep))
    begins, stops = marks
    joined = begins[1:] == stops[:-1]
    begins, stops = begins[np.concatenate([[True], ~joined])[: len(begins)]], stops[np.concatenate([~joined, [True]])[: len(stops)]]
    of, begins = np.divmod(begins, whole)
    stops = stops - of * whole
    pairs = np.bincount(of, minlength=n)
    sizes = 2 * pairs + 1
    first = np.cumsum(sizes) - sizes
    out = np.full(sizes.sum(), height * width, np.int64)
    spot = 2 * np.arange(len(of)) + of
    out[spot], out[spot + 1] = begins, stops
    lengths = np.diff(out, prepend=0)
    lengths[first] = out[first]
    last = first + sizes - 1
    bare = lengths[last] == 0
    keep = np.ones(len(lengths), bool)
    keep[last[bare]] = False
    return lengths[keep], sizes - bare


def strings(counts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """to_string of many masks: their run lengths one after the other, and how many each has (one at least)."""
    first = np.cumsum(sizes) - sizes
    x = counts.copy()
    late = np.flatnonzero(np.arange(len(x)) - np.repeat(first, sizes) > 2)
    x[late] -= counts[late - 2]
    live, signs, used = np.ones(len(x), bool), [], []
    while live.any():
        low, x = x & 31, x >> 5
        done = x == np.where(low & 16, -1, 0)
        signs.append((np.where(done, low, low | 32) + 48).astype(np.uint8))
        used.append(live)
        live = live & ~done
    if not used:
        return pa.array([], pa.string())
    used = np.stack(used, axis=1)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(used.sum(axis=1), first))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.stack(signs, axis=1)[used].tobytes()))


def from_string(text: str) -> list[int]:
    counts: list[int] = []
    x = shift = 0
    for ch in text:
        group = ord(ch) - 48
        x |= (group & 31) << shift
        shift += 5
        if not group & 32:
            if group & 16:
                x -= 1 << shift
            counts.append(x + counts[-2] if len(counts) > 2 else x)
            x = shift = 0
    return counts


def to_mask(counts: list[int], height: int, width: int) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2, counts).astype(bool)
    return flat.reshape(width, height).T
