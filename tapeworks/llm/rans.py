"""Static range asymmetric numeral system over token ids, vectorised over lanes and blocks.

A segment has one frequency table for all its blocks. A block of BLOCK ids is dealt round-robin to LANES
states of 64 bits; every lane that must give way writes one 32-bit word, in the order the decoder reads
them. A checkpoint every STRIDE steps stores the states and the place in the words, so that decoding
starts there as well; each block carries the CRC-32 of its ids.

Block layout (little-endian): u32 ids, u32 words, u32 crc, u32 checkpoints; per checkpoint u32 place
and LANES u64 states; then the words. Table: zlib of u32 n, n u32 ids, n u32 frequencies.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, LOW = 18, 1 << 31
LANES, BLOCK, STRIDE = 32, 16_384, 128
_HEAD = struct.Struct("<4I")


def table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, frequencies that sum to 2**SCALE (each 1 or more), and each id's number."""
    symbols, number, count = np.unique(ids, return_inverse=True, return_counts=True)
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError(f"a segment may have {total} distinct ids")
    freq = np.maximum(1, count * total // max(1, len(ids))).astype(np.int64)
    spare = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare >= 0:
        freq[order[0]] += spare
    else:  # ones that were raised from 0 are taken back from the largest
        for i in order:
            take = min(-spare, int(freq[i]) - 1)
            freq[i] -= take
            spare += take
            if not spare:
                break
    return symbols.astype(np.uint32), freq.astype(np.uint32), number.reshape(-1)


def pack_table(symbols: np.ndarray, freq: np.ndarray) -> bytes:
    return zlib.compress(struct.pack("<I", len(symbols)) + symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)


def unpack_table(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    both = np.frombuffer(raw, "<u4", 2 * n, 4)
    return both[:n], both[n:]


def encode(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """Table and blocks of a segment."""
    if not len(ids):
        return pack_table(np.zeros(0, np.uint32), np.zeros(0, np.uint32)), []
    symbols, freq, number = table(ids)
    f, start = freq.astype(np.uint64), (np.cumsum(freq.astype(np.uint64)) - freq).astype(np.uint64)
    limit = (f * np.uint64((LOW >> SCALE) << 32)) - np.uint64(1)
    blocks = []
    for lo in range(0, len(ids), 128 * BLOCK):  # 128 blocks side by side
        blocks += _encode(ids[lo : lo + 128 * BLOCK], number[lo : lo + 128 * BLOCK], f, start, limit)
    return pack_table(symbols, freq), blocks


def _encode(ids, number, f, start, limit) -> list[bytes]:
    nb = -(-len(ids) // BLOCK)
    steps = BLOCK // LANES if nb > 1 else -(-len(ids) // LANES)
    grid = np.zeros(nb * steps * LANES, np.int64)
    grid[: len(number)] = number
    there = np.zeros(nb * steps * LANES, bool)
    there[: len(number)] = True
    grid, there = (x.reshape(nb, steps, LANES).transpose(1, 0, 2).reshape(steps, nb * LANES) for x in (grid, there))
    x = np.full(nb * LANES, LOW, np.uint64)
    words, wrote, marks = np.zeros((steps, nb * LANES), np.uint32), np.zeros((steps, nb * LANES), bool), {}
    short = ~there.all(axis=1)
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        fs = f[s]
        full = x > limit[s]
        if short[t]:
            full &= there[t]
        words[t] = x.astype(np.uint32)
        wrote[t] = full
        y = np.where(full, x >> np.uint64(32), x)
        q = y // fs
        y += q * (np.uint64(1 << SCALE) - fs) + start[s]  # q * 2**SCALE + (y - q * f) + start
        x = np.where(there[t], y, x) if short[t] else y
        if t % STRIDE == 0:
            marks[t] = x
    per = wrote.reshape(steps, nb, LANES)
    places = np.vstack((np.zeros((1, nb), np.int64), np.cumsum(per.sum(axis=2), axis=0)))
    words = words.reshape(steps, nb, LANES)
    out = []
    for b in range(nb):
        n = min(BLOCK, len(ids) - b * BLOCK)
        own = words[:, b][per[:, b]]
        own_marks = [t for t in sorted(marks) if t * LANES < n]
        out.append(b"".join([
            _HEAD.pack(n, len(own), zlib.crc32(ids[b * BLOCK : b * BLOCK + n].astype("<u4").tobytes()), len(own_marks)),
            *(struct.pack("<I", places[t, b]) + marks[t][b * LANES : (b + 1) * LANES].astype("<u8").tobytes() for t in own_marks), own.astype("<u4").tobytes(),
        ]))
    return out


def decode(packed: bytes, blocks: list[bytes]) -> np.ndarray:
    """Ids of a segment's blocks; all stretches between checkpoints run side by side. Raises on a wrong checksum."""
    symbols, freq = unpack_table(packed)
    if not blocks:
        return np.zeros(0, np.uint32)
    f, start = freq.astype(np.uint64), (np.cumsum(freq.astype(np.uint64)) - freq).astype(np.uint64)
    which = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    out = [_decode(blocks[lo : lo + 128], symbols, f, start, which) for lo in range(0, len(blocks), 128)]
    return np.concatenate(out)


def _decode(blocks, symbols, f, start, which) -> np.ndarray:
    states, place, left, streams, base, sizes, sums = [], [], [], [], 0, [], []
    for data in blocks:
        n, n_words, crc, marks = _HEAD.unpack_from(data)
        at = _HEAD.size
        for k in range(marks):
            place.append(base + struct.unpack_from("<I", data, at)[0])
            states.append(np.frombuffer(data, "<u8", LANES, at + 4))
            left.append(min(STRIDE * LANES, n - k * STRIDE * LANES))
            at += 4 + 8 * LANES
        streams.append(np.frombuffer(data, "<u4", n_words, at))
        base += n_words
        sizes.append(n)
        sums.append(crc)
    x, place, left = np.array(states, np.uint64), np.array(place, np.int64), np.array(left, np.int64)
    words = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    steps = min(STRIDE, -(-int(left.max()) // LANES))
    got = np.zeros((len(left), steps, LANES), np.int32)
    lane, mask = np.arange(LANES), np.uint64((1 << SCALE) - 1)
    for t in range(steps):
        slot = x & mask
        s = which[slot.astype(np.int64)]
        y = f[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        live = t * LANES + lane < left[:, None]
        need = (y < np.uint64(LOW)) & live
        order = np.cumsum(need, axis=1)
        at = np.minimum(place[:, None] + order - 1, len(words) - 1)
        y = np.where(need, (y << np.uint64(32)) | words[at], y)
        x = np.where(live, y, x)
        place += order[:, -1]
        got[:, t] = s
    flat = got.reshape(len(left), -1)
    ids = symbols[np.concatenate([flat[i, :n] for i, n in enumerate(left)])]
    at = 0
    for n, crc in zip(sizes, sums, strict=True):
        if zlib.crc32(ids[at : at + n].astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
        at += n
    return ids
