"""Patched frame-of-reference coding of token ids.

A frame is one document's ids in blocks of 128 (the last may be shorter). Of a
block the minimum is subtracted; the differences are packed at a width that
holds the chosen percentile of them; the high parts of those that need more
are kept in an exception list. Layout, little-endian:

    frame  = n_ids u32, n_blocks u32, start of each block in the body u32[n_blocks], body
    block  = minimum u32, count u16, width u8, number of exceptions u8,
             packed low parts (64-bit words, 64 values take ``width`` words),
             positions u8[exceptions], high parts u32[exceptions]

Blocks of one width are packed together across a batch of documents.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
PERCENTILE = 90
_HEAD = np.dtype([("min", "<u4"), ("count", "<u2"), ("width", "u1"), ("exceptions", "u1")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, 64) values to (m, width) 64-bit words."""
    out = np.zeros((len(values), max(width, 1)), np.uint64)
    v = values.T.copy()
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[j] >> np.uint64(64 - shift)
    return out[:, :width]


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """(m, width) words to (m, 64) values."""
    out = np.zeros((64, len(words)), np.uint64)
    w = words.T.copy()
    mask = np.uint64((1 << width) - 1)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        x = w[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= w[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return out.T


def encode(documents: list[np.ndarray], percentile: int = PERCENTILE) -> list[bytes]:
    """A frame for each array of unsigned 32-bit ids."""
    sizes = np.array([len(d) for d in documents], np.int64)
    per = -(-sizes // BLOCK)
    total = int(per.sum())
    if not total:
        return [struct.pack("<II", 0, 0) for _ in documents]
    first = np.concatenate([[0], np.cumsum(per)])
    grid = np.zeros(total * BLOCK, np.uint32)
    at = np.repeat(first[:-1] * BLOCK - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    grid[at] = np.concatenate(documents)
    grid = grid.reshape(total, BLOCK)
    count = np.full(total, BLOCK, np.int64)
    some = per > 0
    count[first[1:][some] - 1] = sizes[some] - (per[some] - 1) * BLOCK
    real = np.arange(BLOCK) < count[:, None]
    least = np.where(real, grid, np.uint32(0xFFFFFFFF)).min(1)
    rest = np.where(real, grid - least[:, None], 0).astype(np.uint32)
    ordered = np.sort(rest, 1)
    at_percentile = ordered[np.arange(total), BLOCK - 1 - (count * (100 - percentile)) // 100]
    width = np.where(at_percentile > 0, np.floor(np.log2(np.maximum(at_percentile, 1))).astype(np.int64) + 1, 0)
    over = (rest >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0) & (width < 32)[:, None]
    low = (rest & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None].astype(np.uint32)).astype(np.uint64)
    exceptions = over.sum(1)
    head = np.zeros(total, _HEAD)
    head["min"], head["count"], head["width"], head["exceptions"] = least, count, width, exceptions
    heads, body = head.tobytes(), [b""] * total
    where, spots = np.nonzero(over)
    high = (rest[where, spots] >> width[where].astype(np.uint32)).astype("<u4").tobytes()
    spots = spots.astype(np.uint8).tobytes()
    ends = np.cumsum(exceptions)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        words = _pack(low[which].reshape(-1, 64), int(w)).astype("<u8").reshape(len(which), -1)
        # The second half of a block of up to 64 ids is left out.
        raw, half = words.tobytes(), int(w) * 8
        for i, b in enumerate(which.tolist()):
            e, x = int(ends[b]), int(exceptions[b])
            packed = raw[i * 2 * half : i * 2 * half + (half if count[b] <= 64 else 2 * half)]
            body[b] = heads[8 * b : 8 * b + 8] + packed + (spots[e - x : e] + high[4 * (e - x) : 4 * e] if x else b"")
    lengths = np.array([len(x) for x in body], np.int64)
    out = []
    for k in range(len(documents)):
        a, b = first[k], first[k + 1]
        starts = (np.cumsum(lengths[a:b]) - lengths[a:b]).astype("<u4").tobytes()
        out.append(struct.pack("<II", int(sizes[k]), int(b - a)) + starts + b"".join(body[a:b]))
    return out


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """The ids of each frame."""
    blocks, sizes, per = [], [], []
    for f in frames:
        n, k = struct.unpack_from("<II", f)
        starts = np.frombuffer(f, "<u4", k, 8).astype(np.int64) + 8 + 4 * k
        edges = [*starts.tolist(), len(f)]
        blocks += [f[a:b] for a, b in zip(edges, edges[1:])]
        sizes.append(n)
        per.append(k)
    total = len(blocks)
    grid = np.zeros((total, BLOCK), np.uint32)
    head = np.frombuffer(b"".join(b[:8] for b in blocks), _HEAD)
    width = head["width"].astype(np.int64)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        half = int(w) * 8
        raw = b"".join(blocks[b][8 : 8 + 2 * half] if head["count"][b] > 64 else blocks[b][8 : 8 + half] + bytes(half) for b in which.tolist())
        words = np.frombuffer(raw, "<u8").reshape(-1, int(w)) if w else np.zeros((2 * len(which), 0), np.uint64)
        grid[which] = _unpack(words, int(w)).reshape(-1, BLOCK).astype(np.uint32)
    patched = np.flatnonzero(head["exceptions"])
    if len(patched):
        x = head["exceptions"][patched].astype(np.int64)
        tails = [blocks[b][-5 * int(k) :] for b, k in zip(patched.tolist(), x.tolist())]
        spots = np.frombuffer(b"".join(t[:k] for t, k in zip(tails, x.tolist())), np.uint8)
        high = np.frombuffer(b"".join(t[k:] for t, k in zip(tails, x.tolist())), "<u4")
        rows = np.repeat(patched, x)
        grid[rows, spots] |= high << width[rows].astype(np.uint32)
    grid += head["min"][:, None]
    ends = np.cumsum(per) * BLOCK
    flat = grid.reshape(-1)
    return [flat[int(e) - int(k) * BLOCK : int(e) - int(k) * BLOCK + n] for e, k, n in zip(ends, per, sizes)]


def block_at(frame: bytes, i: int) -> np.ndarray:
    """Block ``i`` of a frame alone, found by the index of block starts."""
    n, k = struct.unpack_from("<II", frame)
    starts = [*struct.unpack_from(f"<{k}I", frame, 8), len(frame) - 8 - 4 * k]
    body = frame[8 + 4 * k + starts[i] : 8 + 4 * k + starts[i + 1]]
    return decode([struct.pack("<III", min(BLOCK, n - i * BLOCK), 1, 0) + body])[0]
