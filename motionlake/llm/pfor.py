"""Patched frame-of-reference blocks of token ids.

Layout of one image (little endian):

    magic "PFR1" | block length u32 | documents u32 | blocks u32 | ids u64
    document lengths      u32 * documents
    block starts          u64 * blocks      offset of each block from the start of the image
    blocks, each:         minimum u32 | ids u32 | width u8 | pad u8 | exceptions u16
                          packed (id - minimum) at ``width`` bits, low bit first, whole bytes
                          exception positions u16 * exceptions | exception values u32 * exceptions

A block's width is that of one of the percentiles in PERCENTILES of its shifted ids, the one that makes the block
smallest; ids that are wider are stored in the exception list and packed as their low bits.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIIQ")
BLOCK_HEAD = np.dtype([("low", "<u4"), ("n", "<u4"), ("width", "u1"), ("pad", "u1"), ("exceptions", "<u2")])
BLOCK = 1024
PERCENTILES = (0.75, 0.9, 0.95, 0.99, 1.0)
EXCEPTION_BITS = 48


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values to (blocks, bytes) at ``width`` bits each."""
    bits = np.empty((*values.shape, width), dtype=np.uint8)
    for i in range(width):
        bits[..., i] = (values >> np.uint32(i)) & np.uint32(1)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), -1, width)
    out = np.zeros(bits.shape[:2], dtype=np.uint32)
    for i in range(width):
        out |= bits[..., i].astype(np.uint32) << np.uint32(i)
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    """An image of the documents whose ids stand one after the other in ``ids``."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n_blocks = -(-len(ids) // block)
    counts = np.full(n_blocks, block, dtype=np.uint32)
    if n_blocks:
        counts[-1] = len(ids) - block * (n_blocks - 1)
    grid = np.empty(n_blocks * block, dtype=np.uint32)
    grid[: len(ids)] = ids
    if n_blocks:
        grid[len(ids) :] = ids[-1]
    grid = grid.reshape(n_blocks, block)
    low = grid.min(axis=1) if n_blocks else np.empty(0, np.uint32)
    shifted = grid - low[:, None]
    wide = np.frexp(shifted.astype(np.float64))[1].astype(np.uint8)  # bits that each id needs
    ranked = np.sort(wide, axis=1)
    best_width, best_cost = np.zeros(n_blocks, np.int64), np.full(n_blocks, np.iinfo(np.int64).max)
    for p in PERCENTILES:
        w = ranked[:, int(p * (block - 1))].astype(np.int64)
        cost = w * block + EXCEPTION_BITS * (wide > w[:, None]).sum(axis=1)
        better = cost < best_cost
        best_width[better], best_cost[better] = w[better], cost[better]
    packed: list = [b""] * n_blocks
    for w in np.unique(best_width):
        rows = np.flatnonzero(best_width == w)
        if w:
            for r, line in zip(rows.tolist(), _pack(shifted[rows] & np.uint32((1 << int(w)) - 1), int(w))):
                packed[r] = line[: -(-int(counts[r]) * int(w) // 8)].tobytes()
    parts, starts = [], np.empty(n_blocks, "<u8")
    at = HEAD.size + 4 * len(lengths) + 8 * n_blocks
    for r in range(n_blocks):
        n = int(counts[r])
        spots = np.flatnonzero(wide[r, :n] > best_width[r])
        head = np.array([(low[r], n, best_width[r], 0, len(spots))], dtype=BLOCK_HEAD).tobytes()
        body = head + packed[r] + spots.astype("<u2").tobytes() + shifted[r, spots].astype("<u4").tobytes()
        starts[r] = at
        at += len(body)
        parts.append(body)
    return HEAD.pack(MAGIC, block, len(lengths), n_blocks, len(ids)) + np.asarray(lengths, "<u4").tobytes() + starts.tobytes() + b"".join(parts)


def lengths_of(image: bytes) -> np.ndarray:
    _, _, n_docs, _, _ = HEAD.unpack_from(image)
    return np.frombuffer(image, "<u4", n_docs, HEAD.size)


def decode(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (all by default); the block starts give random access."""
    magic, block, n_docs, n_blocks, _ = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference image")
    last = n_blocks if last is None else min(last, n_blocks)
    starts = np.frombuffer(image, "<u8", n_blocks, HEAD.size + 4 * n_docs)[first:last].astype(np.int64)
    if not len(starts):
        return np.empty(0, np.uint32)
    raw = np.frombuffer(image, np.uint8)
    heads = raw[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD).reshape(-1)
    n = heads["n"].astype(np.int64)
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]), np.uint32)
    for w in np.unique(heads["width"]).tolist():
        for full in (True, False):
            rows = np.flatnonzero((heads["width"] == w) & ((n == block) == full))
            for group in [rows] if full else [rows[i : i + 1] for i in range(len(rows))]:
                if not len(group):
                    continue
                k = int(n[group[0]])
                size = -(-k * w // 8)
                if w:
                    bits = raw[starts[group][:, None] + BLOCK_HEAD.itemsize + np.arange(size)]
                    if k * w % 8:  # unpack whole ids only
                        padded = np.zeros((len(group), w * -(-k // 8)), np.uint8)
                        padded[:, :size] = bits
                        bits = padded
                    values = _unpack(bits, w)[:, :k]
                else:
                    values = np.zeros((len(group), k), np.uint32)
                values = values + heads["low"][group][:, None]
                for g, line in zip(group.tolist(), values):
                    out[ends[g] - n[g] : ends[g]] = line
    for g in np.flatnonzero(heads["exceptions"]).tolist():
        e, at = int(heads["exceptions"][g]), int(starts[g]) + BLOCK_HEAD.itemsize + -(-int(n[g]) * int(heads["width"][g]) // 8)
        spots = np.frombuffer(image, "<u2", e, at)
        out[int(ends[g] - n[g]) + spots.astype(np.int64)] = np.frombuffer(image, "<u4", e, at + 2 * e) + heads["low"][g]
    return out
