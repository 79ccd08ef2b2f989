"""Range asymmetric numeral coding of token ids with one static table: independent blocks of interleaved lanes.

A block holds up to `lanes * steps` ids; lane k codes ids k, k + lanes, k + 2 lanes, ... with a 64-bit state of its
own, and all lanes write their 32-bit words into one stream, in the order the decoder asks for them. Every
`checkpoint` steps the states of all lanes and the place in the stream are noted, so a decoder may begin at any
checkpoint: all stretches between checkpoints of many blocks are decoded side by side, one NumPy step for all lanes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)
_PART = 21  # bits of a table entry's parts: three fit 64 bits
_LAST = np.uint64((1 << _PART) - 1)


class CorruptTokens(ValueError):
    """Coded ids that do not decode to what was written."""


def shared_frequencies(counts: np.ndarray, precision: int) -> np.ndarray:
    """Counts of the ids scaled to a sum of 2**precision, at least 1 for every id that occurs."""
    counts = np.asarray(counts, object)  # exact: counts of a whole corpus times 2**precision pass 64 bits
    seen = np.flatnonzero(counts)
    total, size = sum(counts.tolist()), 1 << precision
    if len(seen) > size:
        raise ValueError(f"{len(seen)} different ids do not fit a table of 2**{precision} entries")
    out = np.zeros(len(counts), np.uint64)
    if total:
        share = [divmod(int(counts[i]) * (size - len(seen)), total) for i in seen]
        out[seen] = [1 + q for q, _ in share]
        left = size - int(out.sum())
        most = sorted(range(len(seen)), key=lambda k: (-share[k][1], k))[:left]
        out[seen[most]] += np.uint64(1)
    return out


@dataclass(frozen=True)
class Shape:
    precision: int = 18
    lanes: int = 32
    steps: int = 512
    checkpoint: int = 256

    @property
    def block(self) -> int:
        return self.lanes * self.steps

    @property
    def checkpoints(self) -> int:
        return -(-self.steps // self.checkpoint)


@dataclass(frozen=True)
class Block:
    ids: int             # how many
    crc32: int           # of the ids as little-endian unsigned 32 bits
    words: bytes         # the stream
    places: np.ndarray   # of each checkpoint in the stream, in words
    states: np.ndarray   # checkpoints x lanes


class Coder:
    def __init__(self, frequencies: np.ndarray, shape: Shape = Shape()):
        self.shape, self.frequency = shape, np.asarray(frequencies, np.uint64)
        if not 1 <= shape.precision <= _PART - 1 or len(self.frequency) > 1 << _PART:
            raise ValueError(f"precision and ids have at most {_PART - 1} and {_PART} bits")
        start = np.cumsum(self.frequency) - self.frequency
        #: of each id its start and frequency; of each slot its id, the id's frequency and the place in it: one look-up a step
        self.by_id = (start << np.uint64(_PART)) | self.frequency
        each = self.frequency.astype(np.int64)
        inside = np.arange(int(each.sum())) - np.repeat(start.astype(np.int64), each)
        self.by_slot = ((np.repeat(np.arange(len(each), dtype=np.uint64), each) << np.uint64(2 * _PART))
                        | (np.repeat(self.frequency, each) << np.uint64(_PART)) | inside.astype(np.uint64))

    def _active(self, count: np.ndarray, step: np.ndarray | int) -> np.ndarray | None:
        """Which lanes of each block hold an id at a step; None for all."""
        lanes = self.shape.lanes
        if np.all((step + 1) * lanes <= count):
            return None
        return (np.asarray(step) * lanes)[..., None] + np.arange(lanes) < count[:, None]

    def encode(self, ids: np.ndarray) -> list[Block]:
        shape, n = self.shape, len(ids)
        if n and (int(ids.max()) >= len(self.frequency) or not self.frequency[ids].all()):
            raise ValueError("an id that the table does not hold")
        blocks = -(-n // shape.block)
        padded = np.zeros(blocks * shape.block, np.int64)
        padded[:n] = ids
        symbols = np.ascontiguousarray(padded.reshape(blocks, shape.steps, shape.lanes).transpose(1, 0, 2))
        count = np.minimum(shape.block, n - np.arange(blocks) * shape.block)
        state = np.full((blocks, shape.lanes), _LOW)
        word = np.zeros(symbols.shape, "<u4")
        written = np.zeros(symbols.shape, bool)
        states = np.zeros((blocks, shape.checkpoints, shape.lanes), np.uint64)
        precision, top = np.uint64(shape.precision), np.uint64(63 - shape.precision)
        for step in range(shape.steps - 1, -1, -1):
            active = self._active(count, step)
            entry = self.by_id[symbols[step]]
            frequency, start = entry & _LAST, entry >> np.uint64(_PART)
            if active is not None:
                frequency = np.where(active, frequency, np.uint64(1))
            over = state >= (frequency << top)
            if active is not None:
                over &= active
            word[step], written[step] = state & _MASK, over
            state = np.where(over, state >> _WORD, state)
            quotient = state // frequency
            coded = (quotient << precision) + (state - quotient * frequency) + start
            state = coded if active is None else np.where(active, coded, state)
            if step % shape.checkpoint == 0:
                states[:, step // shape.checkpoint] = state
        each = written.sum(2)
        places = (np.cumsum(each, 0) - each)[::shape.checkpoint].T
        flat = np.asarray(ids, "<u4")
        return [Block(int(count[b]), zlib.crc32(flat[b * shape.block:b * shape.block + int(count[b])].tobytes()),
                      word[:, b][written[:, b]].tobytes(), places[b].astype("<u4"), states[b]) for b in range(blocks)]

    def decode(self, blocks: list[Block]) -> np.ndarray:
        """The ids of the blocks one after another; every block must give its checksum and end in the first state."""
        shape, made = self.shape, len(blocks)
        if not made:
            return np.zeros(0, np.uint32)
        sizes = np.array([len(b.words) // 4 for b in blocks])
        words = np.append(np.frombuffer(b"".join(b.words for b in blocks), "<u4").astype(np.uint64), np.zeros(shape.lanes, np.uint64))
        base = np.cumsum(sizes) - sizes
        counts = np.array([b.ids for b in blocks])
        state = np.concatenate([b.states for b in blocks]).astype(np.uint64)
        place = (base[:, None] + np.stack([b.places for b in blocks]).astype(np.int64)).ravel()
        count, first = np.repeat(counts, shape.checkpoints), np.tile(np.arange(shape.checkpoints) * shape.checkpoint, made)
        out = np.zeros((shape.checkpoint, *state.shape), np.uint32)
        precision, mask = np.uint64(shape.precision), np.uint64((1 << shape.precision) - 1)
        part, parts, last = np.uint64(_PART), np.uint64(2 * _PART), len(words) - 1
        for step in range(shape.checkpoint):
            active = self._active(count, first + step)
            entry = self.by_slot[(state & mask).astype(np.int64)]
            found = ((entry >> part) & _LAST) * (state >> precision) + (entry & _LAST)
            need = found < _LOW
            if active is not None:
                need &= active
            each = need.sum(1)
            at = np.flatnonzero(need)
            # the words of a step lie one after another in lane order: the n-th lane in need takes the n-th word
            read = np.arange(len(at)) + np.repeat(place - (np.cumsum(each) - each), each)
            flat = found.ravel()
            flat[at] = (flat[at] << _WORD) | words[np.minimum(read, last)]
            state = found if active is None else np.where(active, found, state)
            place += each
            out[step] = entry >> parts
        ids = out.reshape(shape.checkpoint, made, shape.checkpoints, shape.lanes).transpose(1, 2, 0, 3).reshape(made, -1)[:, :shape.block]
        ended = state.reshape(made, shape.checkpoints, shape.lanes)[:, -1]
        for b, block in enumerate(blocks):
            if zlib.crc32(ids[b, :block.ids].astype("<u4").tobytes()) != block.crc32 or (shape.steps % shape.checkpoint == 0 and (ended[b] != _LOW).any()):
                raise CorruptTokens("a block of token ids does not give its checksum")
        return ids.ravel() if (counts == shape.block).all() else np.concatenate([ids[b, :n] for b, n in enumerate(counts)])
