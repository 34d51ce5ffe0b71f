"""Context-mixing range coder for token ids, over many independent blocks at once.

A segment holds up to ``LANES`` blocks of ``BLOCK`` ids. Every block has its
own coder and its own model, reset at its start; numpy runs the same step of
all blocks together. The chance of an id is a mixture of three predictions:
order 2 and order 1 each name the id that last followed the two ids, or the
one id, before (in tables by a hash of them), with the rate of hits that this
block has seen at the present runs of hits of both as its weight; order 0
gives every id its frequency in the segment, from the segment's header. The
chances are integers, so coder and decoder agree on every machine.

The range coder keeps 64 bits and gives out 32 at a time, at most once an id:
where the range falls below 2^32 and would reach over a multiple of 2^32, it
is cut there. A segment's bytes are its header, for each block its number of
ids, of 32-bit words and the CRC-32 of its ids, and the blocks' words. A block
can be decoded without any other; a wrong checksum raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
LANES = 4096
MAGIC = b"CMR2"
TABLE_BITS = 10
WEIGHT_BITS = 10
FREQUENCY_BITS = 18
LEVEL_BITS = 2
_TOTAL = WEIGHT_BITS + FREQUENCY_BITS
_U = np.uint64
_WORD, _LEAST, _LOW = _U(32), _U(1 << 32), _U((1 << 32) - 1)
_RATE_STEP = 4
_RATE_GAIN = ((1 << WEIGHT_BITS) - 1) >> _RATE_STEP


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids present, their integer frequencies), which add up to 2^18."""
    present, counts = np.unique(ids, return_counts=True)
    room = (1 << FREQUENCY_BITS) - len(present)
    shares = 1 + counts * room // counts.sum()
    shares[np.argmax(counts)] += (1 << FREQUENCY_BITS) - shares.sum()
    return present, shares


class Prior:
    """Order 0: first slot and frequency of each id, and the id of each slot."""

    def __init__(self, present: np.ndarray, shares: np.ndarray):
        size = int(present[-1]) + 1
        self.frequency, self.first = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.frequency[present] = shares
        self.first[present] = np.cumsum(shares) - shares
        self.of_slot = np.repeat(present, shares).astype(np.int32)

    def pack(self) -> bytes:
        present = np.flatnonzero(self.frequency).astype("<u4")
        return zlib.compress(np.diff(present, prepend=0).astype("<u4").tobytes() + self.frequency[present].astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        steps, shares = np.frombuffer(zlib.decompress(data), dtype="<u4").reshape(2, -1).astype(np.int64)
        return cls(np.cumsum(steps), shares)


class Model:
    """The adaptive predictions of ``lanes`` blocks; row 0 of every pair of rows is order 1, row 1 is order 2.

    An entry is an id and, in its low bits, its level: how often running it came
    true, up to 3, or 0 where none was seen. A pair of levels has one number with
    the hit rates of order 2 (upper half) and of order 1 (lower half).
    """

    def __init__(self, lanes: int):
        self.entries = np.zeros(2 * lanes << TABLE_BITS, dtype=np.int32)
        levels = np.arange(1 << LEVEL_BITS, dtype=np.int32)
        start = (levels << WEIGHT_BITS) // (len(levels) + 1)
        self.rates = np.tile(((start[:, None] << 16) | start).reshape(-1), lanes)
        self.row = (np.arange(2 * lanes, dtype=np.int64) << TABLE_BITS).reshape(2, lanes)
        self.rate_row = np.arange(lanes, dtype=np.int64) << (2 * LEVEL_BITS)

    def places(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places of the entries for the two ids before: the last axis is that of the blocks, before it the two orders."""
        n, shift = last.shape[-1], np.uint32(32 - TABLE_BITS)
        out = np.empty((*last.shape[:-1], 2, n), dtype=np.int64)
        mixed = last.view(np.uint32) * np.uint32(0x9E3779B1)
        np.add(mixed >> shift, self.row[0, :n], out=out[..., 0, :])
        mixed += before.view(np.uint32) * np.uint32(0x85EBCA77)
        np.add(mixed >> shift, self.row[1, :n], out=out[..., 1, :])
        return out

    def predict(self, at: np.ndarray):
        """Fixes the step's predictions and weights."""
        self.at = at
        entry = self.entries.take(at)
        self.level = entry & np.int32((1 << LEVEL_BITS) - 1)
        entry >>= LEVEL_BITS
        self.ids = entry
        at_rate = self.level[1] << LEVEL_BITS
        at_rate += self.level[0]
        self.at_rate = at_rate + self.rate_row[: at.shape[-1]]
        self.rate = self.rates.take(self.at_rate)
        weight = np.empty_like(entry)
        one, two = weight
        np.right_shift(self.rate, 16, out=two)
        self.rest = np.int32(1 << WEIGHT_BITS) - two
        np.bitwise_and(self.rate, np.int32(0xFFFF), out=one)
        one *= self.rest
        one >>= WEIGHT_BITS
        self.rest -= one
        weight <<= FREQUENCY_BITS
        self.weight = weight

    def interval(self, ids: np.ndarray, first: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of the ids' shares of 2^28, from their order 0 given as first slot and frequency."""
        self.hit = self.ids == ids
        begin, size = self.rest * first, self.rest * frequency
        below, equal = self.weight * (self.ids < ids), self.weight * self.hit
        begin += below[0]
        begin += below[1]
        size += equal[0]
        size += equal[1]
        return begin.view(np.uint32), size.view(np.uint32)

    def learn(self, ids: np.ndarray):
        """Takes in the ids that came, after ``interval`` has seen them."""
        rate = self.rate
        rate -= (rate >> _RATE_STEP) & np.int32(_RATE_GAIN << 16 | _RATE_GAIN)
        rate += self.hit[1] * np.int32(_RATE_GAIN << 16)
        rate += self.hit[0] * np.int32(_RATE_GAIN)
        self.rates[self.at_rate] = rate
        level = self.level
        level *= self.hit
        np.minimum(level, np.int32((1 << LEVEL_BITS) - 2), out=level)
        level += (ids << LEVEL_BITS) + np.int32(1)
        self.entries[self.at] = level


def encode(ids: np.ndarray) -> bytes:
    """The segment's bytes of up to ``LANES`` x ``BLOCK`` ids, at least one."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    prior = Prior(*frequencies(ids))
    lanes = -(-len(ids) // BLOCK)
    steps = min(BLOCK, len(ids))
    tail = len(ids) - (lanes - 1) * BLOCK
    grid = np.full((lanes, BLOCK), ids[0], dtype=np.int32)
    grid.reshape(-1)[: len(ids)] = ids
    history = np.zeros((BLOCK + 2, lanes), dtype=np.int32)
    history[2:] = grid.T
    model = Model(lanes)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    width = BLOCK + 1
    words = np.zeros((lanes, width), dtype="<u4")
    flat, begins = words.reshape(-1), np.arange(lanes, dtype=np.int64) * width
    place = begins.copy()
    for t in range(steps):
        n = lanes if t < tail else lanes - 1
        k = t % 128
        if k == 0:
            places = model.places(history[t : t + 128], history[t + 1 : t + 129])
            chunk = history[t + 2 : t + 130]
            firsts, shares = prior.first[chunk], prior.frequency[chunk]
        now = chunk[k, :n]
        model.predict(places[k, :, :n])
        begin, size = model.interval(now, firsts[k, :n], shares[k, :n])
        a, b = low[:n], span[:n]
        b >>= _U(_TOTAL)
        a += b * begin
        b *= size
        move = np.flatnonzero(b < _LEAST)
        if len(move):
            moving, at = a[move], place[move]
            flat[at] = moving >> _WORD
            place[move] = at + 1
            b[move] = np.minimum(b[move], _LEAST - (moving & _LOW)) << _WORD
            a[move] = moving << _WORD
        model.learn(now)
    flat[place] = (low + _LOW) >> _WORD
    used = place - begins + 1
    sizes = np.full(lanes, BLOCK, dtype="<u4")
    sizes[-1] = tail
    sums = np.array([zlib.crc32(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)], dtype="<u4")
    header = prior.pack()
    parts = [struct.pack("<4sII", MAGIC, lanes, len(header)), header]
    parts += [sizes.tobytes(), used.astype("<u4").tobytes(), sums.tobytes()]
    return b"".join(parts + [words[i, : used[i]].tobytes() for i in range(lanes)])


def decode(data: bytes, blocks: slice | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks."""
    magic, lanes, header = struct.unpack_from("<4sII", data)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    at = struct.calcsize("<4sII")
    prior = Prior.unpack(data[at : at + header])
    sizes, lengths, sums = np.frombuffer(data, dtype="<u4", count=3 * lanes, offset=at + header).reshape(3, -1).astype(np.int64)
    begins = at + header + 12 * lanes + 4 * (np.cumsum(lengths) - lengths)
    wanted = np.arange(lanes)[blocks or slice(None)]
    found = _decode(data, prior, sizes[wanted], lengths[wanted], begins[wanted])
    for i, k in enumerate(wanted.tolist()):
        if zlib.crc32(found[i, : sizes[k]].tobytes()) != sums[k]:
            raise ValueError(f"block {k} has a wrong checksum")
    return np.concatenate([found[i, : sizes[k]] for i, k in enumerate(wanted.tolist())])


def _decode(data: bytes, prior: Prior, sizes: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> np.ndarray:
    lanes, steps = len(sizes), int(sizes.max())
    width = max(int(lengths.max()), steps) + 2
    words = np.zeros((lanes, width), dtype=np.uint64)
    for i, (begin, length) in enumerate(zip(begins.tolist(), lengths.tolist())):
        words[i, :length] = np.frombuffer(data, dtype="<u4", count=length, offset=begin)
    flat, place = words.reshape(-1), np.arange(lanes, dtype=np.int64) * width + 2
    code = (words[:, 0] << _WORD) | words[:, 1]
    model = Model(lanes)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    history = np.zeros((steps + 2, lanes), dtype=np.int32)
    most, zero = _U((1 << _TOTAL) - 1), np.int32(0)
    for t in range(steps):
        n = lanes if t < sizes[-1] else int(np.count_nonzero(sizes > t))
        model.predict(model.places(history[t, :n], history[t + 1, :n]))
        a, b, c = low[:n], span[:n], code[:n]
        b >>= _U(_TOTAL)
        value = np.minimum((c - a) // b, most).astype(np.int32)
        # Take the shares of order 2 and then of order 1 out of the value, which leaves that of order 0.
        (id_one, id_two), (one, two) = model.ids, model.weight
        begins_one, begins_two = model.rest * prior.first.take(model.ids, mode="clip")
        begins_two += one * (id_two > id_one)
        over = value - begins_two
        value -= np.minimum(np.maximum(over, zero, out=over), two, out=over)
        over = value - begins_one
        value -= np.minimum(np.maximum(over, zero, out=over), one, out=over)
        now = prior.of_slot.take((value / model.rest).astype(np.int64), mode="clip")
        begin, size = model.interval(now, prior.first.take(now), prior.frequency.take(now))
        a += b * begin
        b *= size
        move = np.flatnonzero(b < _LEAST)
        if len(move):
            moving, at = a[move], place[move]
            c[move] = (c[move] << _WORD) | flat[at]
            place[move] = at + 1
            b[move] = np.minimum(b[move], _LEAST - (moving & _LOW)) << _WORD
            a[move] = moving << _WORD
        model.learn(now)
        history[t + 2, :n] = now
    return np.ascontiguousarray(history[2:].T).astype("<u4")
