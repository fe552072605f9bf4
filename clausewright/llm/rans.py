"""Static range asymmetric numeral system over token ids, in numpy.

A segment is one byte string that is decoded alone:

    4s magic | u32 version, scale bits, lanes, block tokens, checkpoint steps, documents, symbols, blocks | u64 tokens
    i64 id of each document | u8 whether it is null | u32 number of its ids
    u32 each symbol, ascending | u32 its frequency (they sum to 2 ** scale bits)
    u32 words of each block | u32 CRC-32 of each block's ids (little-endian u32)
    for each block and checkpoint: u32 word offset in the block | u64 state of each lane
    u32 words of all blocks
    u32 CRC-32 of everything before

The table is shared by all blocks of the segment. Token i of a block is step i // lanes of lane i % lanes. States lie in
[2**31, 2**63); a lane that leaves the range moves 32 bits. A checkpoint holds the states and the word offset before its
step, so every stretch between checkpoints of every block is decoded independently - here all of them side by side.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"cwRS", 1
LANES, BLOCK, EVERY = 64, 1 << 16, 256
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s8IQ")
_32 = np.uint64(32)


def quantize(counts: np.ndarray, scale: int) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**scale, near the proportions of `counts` (all positive)."""
    freq = np.maximum(1, counts * (1 << scale) // counts.sum())
    excess = int(freq.sum()) - (1 << scale)
    order = np.argsort(-freq, kind="stable")
    if excess < 0:
        freq[order[0]] -= excess
    for i in order if excess > 0 else ():
        take = min(excess, int(freq[i]) - 1)
        freq[i] -= take
        excess -= take
        if not excess:
            break
    return freq


def encode_segment(ids: np.ndarray, sizes: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray) -> bytes:
    """`ids`: those of all documents of the segment, one after the other; `sizes`: how many each has."""
    n = len(ids)
    if n and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        symbol, counts = (np.cumsum(counts > 0) - 1).astype(np.int32)[ids], counts[symbols]
    else:
        symbols, symbol, counts = np.unique(ids, return_inverse=True, return_counts=True)
    scale = min(24, max(12, (4 * len(symbols)).bit_length()))
    freq = quantize(counts, scale) if n else counts
    low = np.cumsum(freq) - freq
    blocks = -(-n // BLOCK)
    steps = -(-np.minimum(BLOCK, n - BLOCK * np.arange(blocks)) // LANES) if n else np.zeros(0, np.int64)
    most = int(steps[0]) if blocks else 0
    padded = np.zeros(blocks * BLOCK, np.int32)
    padded[:n] = symbol
    if n:
        padded[n:] = int(np.argmax(freq))
    by_step = padded.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(BLOCK // LANES, blocks * LANES)[:most]
    f64, c64 = freq.astype(np.uint64), low.astype(np.uint64)
    bound = np.uint64((1 << 31 >> scale) << 32)
    state = np.full(blocks * LANES, LOW, np.uint64)
    word = np.zeros((most, blocks * LANES), np.uint32)
    moved = np.zeros((most, blocks * LANES), bool)
    marks = []
    for t in range(most - 1, -1, -1):
        active = blocks * LANES if not blocks or t < steps[-1] else (blocks - 1) * LANES
        s = by_step[t, :active]
        f, x = f64[s], state[:active]
        out = x >= bound * f
        word[t, :active] = x.astype(np.uint32)
        moved[t, :active] = out
        x = np.where(out, x >> _32, x)
        q = x // f
        state[:active] = (q << np.uint64(scale)) + (x - q * f) + c64[s]
        if t % EVERY == 0:
            marks.append((t, state.copy()))
    per_block = moved.reshape(most, blocks, LANES).sum(axis=2) if n else np.zeros((0, blocks), np.int64)
    words = np.concatenate([word[:, b * LANES : (b + 1) * LANES][moved[:, b * LANES : (b + 1) * LANES]] for b in range(blocks)]) if n else np.zeros(0, np.uint32)
    before = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(per_block, axis=0)])
    marks = marks[::-1]
    offsets, states = [], []
    for b in range(blocks):
        for t, at in marks:
            if t < steps[b]:
                offsets.append(before[t, b])
                states.append(at[b * LANES : (b + 1) * LANES])
    ids32 = ids.astype("<u4")
    sums = [zlib.crc32(ids32[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)]
    body = [
        _HEAD.pack(MAGIC, VERSION, scale, LANES, BLOCK, EVERY, len(sizes), len(symbols), blocks, n),
        doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(),
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
        (before[-1] if n else np.zeros(0)).astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(),
        np.array(offsets, "<u4").tobytes(), (np.concatenate(states) if states else np.zeros(0)).astype("<u8").tobytes(),
        words.astype("<u4").tobytes(),
    ]
    data = b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes, doc_ids and nulls, as encode_segment() took them. Raises ValueError where a checksum fails."""
    if len(data) < _HEAD.size + 4 or data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged segment")
    _, version, scale, lanes, block, every, docs, n_symbols, blocks, n = _HEAD.unpack_from(data)
    if version != VERSION:
        raise ValueError(f"segment of version {version}")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, nulls, sizes = take("<i8", docs), take("u1", docs).astype(bool), take("<u4", docs).astype(np.int64)
    symbols, freq = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.uint64)
    n_words, sums = take("<u4", blocks).astype(np.int64), take("<u4", blocks)
    steps = -(-np.minimum(block, n - block * np.arange(blocks)) // lanes) if n else np.zeros(0, np.int64)
    chunks = -(-steps // every)
    units = int(chunks.sum())
    offsets, state = take("<u4", units).astype(np.int64), take("<u8", units * lanes).copy()
    words = np.append(take("<u4", int(n_words.sum())), np.uint32(0)).astype(np.uint64)
    low = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(n_symbols, dtype=np.int32), freq.astype(np.int64))
    pos = offsets + np.repeat(np.cumsum(n_words) - n_words, chunks)
    last = int(steps[-1] - every * (chunks[-1] - 1)) if units else 0
    most = every if units > 1 else last
    out = np.zeros((most, units * lanes), np.int32)
    mask = np.uint64((1 << scale) - 1)
    for t in range(most):
        active = units if t < last else units - 1
        x = state[: active * lanes]
        slot = x & mask
        s = slots[slot.astype(np.int64)]
        out[t, : active * lanes] = s
        x = freq[s] * (x >> np.uint64(scale)) + slot - low[s]
        need = (x < LOW).reshape(active, lanes)
        count = np.cumsum(need, axis=1)
        read = words[np.where(need, pos[:active, None] + count - 1, -1)].ravel()
        state[: active * lanes] = np.where(need.ravel(), (x << _32) | read, x)
        pos[:active] += count[:, -1]
    ids = np.empty(n, np.uint32)
    unit, flat = 0, symbols[out.reshape(most, units, lanes).transpose(1, 0, 2)] if units else None
    for b in range(blocks):
        end = min(block, n - b * block)
        ids[b * block : b * block + end] = flat[unit : unit + chunks[b]].reshape(-1)[:end]
        unit += int(chunks[b])
        if zlib.crc32(ids[b * block : b * block + end].astype("<u4").tobytes()) != sums[b]:
            raise ValueError(f"damaged block {b}")
    return ids, sizes, doc_ids, nulls
