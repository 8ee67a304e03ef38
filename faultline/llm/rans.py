"""Static range asymmetric numeral system over token ids, many interleaved lanes at a time.

A block holds symbols in rows of LANES: lane l codes symbols l, l + LANES, ... with a state of its own, and all lanes
share one stream of 32-bit words and one frequency table. Every CHECKPOINT_ROWS rows the decoder's states and word
position are kept with a checksum of the words up to the next checkpoint, so any segment decodes without the others.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

PRECISION, LOW = 20, 1 << 31
LANES, CHECKPOINT_ROWS = 2048, 256
SEGMENT = LANES * CHECKPOINT_ROWS
BLOCK_SEGMENTS = 4
HEAD = "<QII"  # symbols in the segment, words in it, crc32 of its states and words


@dataclass
class Frequencies:
    """Scaled frequencies that sum to 2^PRECISION, where each of them starts, and the symbol of each slot."""

    scaled: np.ndarray
    start: np.ndarray

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Frequencies:
        """Every counted symbol gets at least one slot; the rest is dealt in proportion, largest remainders first."""
        seen = np.flatnonzero(counts)
        scaled = np.zeros(len(counts), np.uint64)
        if len(seen):
            free = (1 << PRECISION) - len(seen)
            share = counts[seen] / counts[seen].sum() * free
            whole = np.floor(share)
            spare = int(free - whole.sum())
            whole[np.argsort(whole - share, kind="stable")[:spare]] += 1
            scaled[seen] = (whole + 1).astype(np.uint64)
        return cls(scaled, np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64))

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.scaled), dtype=np.uint32), self.scaled.astype(np.int64))

    def packed(self) -> bytes:
        return zlib.compress(self.scaled.astype("<u4").tobytes(), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Frequencies:
        scaled = np.frombuffer(zlib.decompress(data), "<u4").astype(np.uint64)
        return cls(scaled, np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64))


def encode_block(ids: np.ndarray, table: Frequencies) -> list[bytes]:
    """The block's segments in order. Each has a head, the states that its decoding starts with, and its words."""
    rows = -(-len(ids) // LANES)
    state = np.full(LANES, LOW, np.uint64)
    shift, low_word = np.uint64(32), np.uint64(0xFFFFFFFF)
    segments: list[bytes] = []
    words: list[np.ndarray] = []
    for row in range(rows - 1, -1, -1):
        symbols = ids[row * LANES : (row + 1) * LANES]
        own = state[: len(symbols)]
        frequency = table.scaled[symbols]
        full = own >= frequency << np.uint64(63 - PRECISION)
        words.append((own[full] & low_word).astype("<u4"))
        own[full] >>= shift
        quotient = own // frequency
        own[:] = (quotient << np.uint64(PRECISION)) + (own - quotient * frequency) + table.start[symbols]
        if row % CHECKPOINT_ROWS == 0:
            body = np.concatenate(words[::-1]).astype("<u4")
            packed = state.astype("<u8").tobytes() + body.tobytes()
            inside = min(len(ids), (row + CHECKPOINT_ROWS) * LANES) - row * LANES
            segments.append(struct.pack(HEAD, inside, len(body), zlib.crc32(packed)) + packed)
            words = []
    return segments[::-1]


def decode_segment(data: bytes, table: Frequencies, slots: np.ndarray) -> np.ndarray:
    """The ids of a segment; raises ValueError where its checksum fails."""
    inside, n_words, checksum = struct.unpack_from(HEAD, data)
    packed = data[struct.calcsize(HEAD) : struct.calcsize(HEAD) + 8 * LANES + 4 * n_words]
    if zlib.crc32(packed) != checksum:
        raise ValueError("a segment does not have its checksum")
    state = np.frombuffer(packed, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(packed, "<u4", n_words, 8 * LANES).astype(np.uint64)
    out, taken = np.empty(inside, np.uint32), 0
    mask, bits, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    for at in range(0, inside, LANES):
        own = state[: min(LANES, inside - at)]
        slot = own & mask
        symbols = slots[slot.astype(np.int64)]
        out[at : at + len(own)] = symbols
        own[:] = table.scaled[symbols] * (own >> bits) + slot - table.start[symbols]
        empty = np.flatnonzero(own < np.uint64(LOW))
        own[empty] = (own[empty] << shift) | words[taken : taken + len(empty)]
        taken += len(empty)
    return out
