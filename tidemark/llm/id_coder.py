"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks. Every block starts from the same empty model and has a
checksum of its own, so blocks are decoded alone. Within a block the ids stand
in lanes, runs of neighbouring ids; each step codes the next id of every lane
with one model that all lanes share and then lets it learn from all of them. So
numpy works on thousands of ids at a time, and the model learns from the whole
block.

An id is coded as
  - an event: it is the id that last followed the same two ids (order 2), or
    the one that last followed the previous id (order 1), or neither;
  - if neither, the id itself under the block's counts of such ids (order 0).
An event's probabilities mix two adaptive estimates, one kept by the order-2
prediction's confidence and one by the order-1 prediction's, with a weight that
follows the one that was right more often. Model and coder are integer
arithmetic (a quotient is taken in double precision where that is exact), so
every machine decodes what any machine encoded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TMIC", 2
#: Ids of a block at most, lanes at most, and ids of a lane at least.
BLOCK_IDS, LANES, LANE_IDS = 1 << 21, 4096, 128
_FILE = struct.Struct("<4sBxxxI")  # magic, version, blocks
_HEAD = struct.Struct("<IIIII")  # ids, lanes, one more than the largest id, checksum, words
_TOP, _BOTTOM, _LOW32 = 1 << 48, 1 << 32, (1 << 32) - 1
#: Events have shares of 2**_EVENT_BITS; ids of 2**20, or twice their number where that is more.
_EVENT_BITS, _ID_BITS, _MOST_BITS = 16, 20, 20
_SLOT_BITS = 18
_SURE = 3  # confidence grows to this


class _Encoder:
    """Range coder of many lanes; its words come in the order in which a decoder asks for them."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, _TOP)
        self.words: list[np.ndarray] = []
        self.of: list[np.ndarray] = []

    def _shift(self, lanes: np.ndarray) -> np.ndarray:
        low = self.low[lanes]
        self.words.append(low >> 32)  # bit 16 is a carry, settled at the end
        self.of.append(lanes)
        self.low[lanes] = (low & _LOW32) << 16
        self.range[lanes] <<= 16
        return lanes

    def events(self, n: int, bounds: np.ndarray, context: np.ndarray, event: np.ndarray) -> np.ndarray:
        """Code one event for each of the first n lanes; bounds[context] holds where its events begin and end."""
        at = context * 4 + event
        flat = bounds.ravel()
        start = flat.take(at)
        r = self.range[:n] >> _EVENT_BITS
        self.low[:n] += r * start
        r *= flat.take(at + 1) - start
        self.range[:n] = r
        self._shift(np.flatnonzero(r < _BOTTOM))
        return event

    def ids(self, lanes: np.ndarray, bits: int, starts: np.ndarray, find: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
        """Code an id for each of some lanes; starts[i] .. starts[i + 1] is its share of 2**bits."""
        start = starts.take(ids)
        r = self.range[lanes] >> bits
        self.low[lanes] += r * start
        r *= starts.take(ids + 1) - start
        self.range[lanes] = r
        small = lanes[r < _BOTTOM]
        while len(small):
            self._shift(small)
            small = small[self.range[small] < _BOTTOM]
        return ids

    def finish(self) -> np.ndarray:
        """Every word, 16 bits each."""
        n = len(self.low)
        every = np.arange(n)
        for shift in (32, 16, 0):
            self.words.append(self.low >> 32 if shift == 32 else (self.low >> shift) & 0xFFFF)
            self.of.append(every)
        words, of = np.concatenate(self.words), np.concatenate(self.of)
        order = np.argsort(of.astype(np.uint16), kind="stable")
        by_lane = words[order]
        while len(carry := np.flatnonzero(by_lane >> 16)):
            by_lane[carry] &= 0xFFFF
            np.add.at(by_lane, carry - 1, 1)
        # A decoder holds three words of a lane at first, and when the encoder gave the lane's k-th it asks for the one three later.
        first = np.searchsorted(of[order], every)
        out = np.empty(len(words), np.uint16)
        for k in range(3):
            out[k * n : (k + 1) * n] = by_lane[first + k]
        later = np.ones(len(words), bool)
        for k in range(3):
            later[first + k] = False
        place = np.flatnonzero(later)
        out[3 * n + order[place - 3]] = by_lane[place]
        return out


class _Decoder:
    def __init__(self, lanes: int, words: np.ndarray):
        self.words = words.astype(np.int64)
        first = self.words[: 3 * lanes].reshape(3, lanes)
        self.code, self.range, self.at = first[0] << 32 | first[1] << 16 | first[2], np.full(lanes, _TOP), 3 * lanes

    def _shift(self, lanes: np.ndarray) -> None:
        self.code[lanes] = self.code[lanes] << 16 | self.words[self.at : self.at + len(lanes)]
        self.range[lanes] <<= 16
        self.at += len(lanes)

    def events(self, n: int, bounds: np.ndarray, context: np.ndarray, _) -> np.ndarray:
        r = self.range[:n] >> _EVENT_BITS
        value = (self.code[:n] / r).astype(np.int64)
        flat, at = bounds.ravel(), context * 4
        event = (value >= flat.take(at + 1)).astype(np.int64)
        event += value >= flat.take(at + 2)
        at += event
        start = flat.take(at)
        self.code[:n] -= r * start
        r *= flat.take(at + 1) - start
        self.range[:n] = r
        self._shift(np.flatnonzero(r < _BOTTOM))
        return event

    def ids(self, lanes: np.ndarray, bits: int, starts: np.ndarray, find: np.ndarray, _) -> np.ndarray:
        r, code = self.range[lanes] >> bits, self.code[lanes]
        ids = find.take((code / r).astype(np.int64)).astype(np.int64)
        start = starts.take(ids)
        self.code[lanes] = code - r * start
        r *= starts.take(ids + 1) - start
        self.range[lanes] = r
        small = lanes[r < _BOTTOM]
        while len(small):
            self._shift(small)
            small = small[self.range[small] < _BOTTOM]
        return ids


class _Model:
    """The adaptive state of a block."""

    def __init__(self, ids: int, decoding: bool):
        self.decoding = decoding
        # Predictions: the id seen last after a context, times 4, plus how often it came again (0.._SURE).
        self.one, self.two = np.zeros(ids, np.int64), np.zeros(1 << _SLOT_BITS, np.int64)
        self.seen = np.zeros((4, 4, 2, 3), np.int64)  # order-2 confidence, order-1 confidence, agreement, event
        self.credit = np.ones((2, 4, 4, 2), np.int64)  # how often either estimate was the better one
        self.counts, self.new = np.zeros(ids, np.int64), [np.empty(0, np.int64)]
        self.bits = max(_ID_BITS, ids.bit_length() + 1)
        self._mix()
        self.count()

    def _mix(self) -> None:
        """The events' bounds in every context, from what was seen."""
        total = 1 << _EVENT_BITS
        sides = []
        for axis in (1, 0):
            n = self.seen.sum(axis=axis, keepdims=True) * 2 + 1
            sides.append(n * total // n.sum(axis=-1, keepdims=True))
        self.sides = np.broadcast_arrays(*sides)
        weight = (self.credit[0] * total // (self.credit[0] + self.credit[1]))[..., None]
        p = np.clip(sides[1] + ((sides[0] - sides[1]) * weight >> _EVENT_BITS), 64, total - 128)
        bounds = np.zeros((32, 4), np.int64)
        bounds[:, 1:] = np.cumsum(p.reshape(32, 3), axis=1)
        bounds[:, 1:3] = bounds[:, 1:3] * (total - 256) // bounds[:, 3:] + np.array([64, 128])
        bounds[:, 3] = total
        self.bounds = bounds

    def count(self) -> None:
        """The order-0 shares, from the ids seen so far; every id has one."""
        self.counts += np.bincount(np.concatenate(self.new), minlength=len(self.counts))
        self.new = [np.empty(0, np.int64)]
        room = (1 << self.bits) - len(self.counts)
        shares = 1 + self.counts * room // max(1, int(self.counts.sum()))
        shares[self.counts.argmax()] += (1 << self.bits) - int(shares.sum())
        self.starts = np.concatenate([[0], np.cumsum(shares)])
        self.find = np.repeat(np.arange(len(shares), dtype=np.int32), shares) if self.decoding else None

    def step(self, coder, n: int, before: np.ndarray, last: np.ndarray, ids: np.ndarray | None, learn: bool) -> np.ndarray:
        """Code one id for each of the first n lanes, after the ids `before`, `last`; ids is None when decoding."""
        slot = ((before * 0x9E3779B1 + last * 0x85EBCA6B) >> 13) & ((1 << _SLOT_BITS) - 1)
        held1, held2 = self.one.take(last), self.two.take(slot)
        guess1, guess2, sure1, sure2 = held1 >> 2, held2 >> 2, held1 & 3, held2 & 3
        agree = guess1 == guess2
        context = sure2 * 8 + sure1 * 2 + agree
        event = None
        if ids is not None:
            hit = ids != guess2
            event = np.where(hit & (ids != guess1), 2, hit)
        event = coder.events(n, self.bounds, context, event)
        out = np.where(event == 0, guess2, guess1)
        rest = np.flatnonzero(event == 2)
        if len(rest):
            out[rest] = plain = coder.ids(rest, self.bits, self.starts, self.find, None if ids is None else ids[rest])
            self.new.append(plain)
        came = np.bincount(context * 3 + event, minlength=96).reshape(4, 4, 2, 3)
        self.seen += came
        better = self.sides[0] > self.sides[1]
        self.credit[0] += (came * better).sum(axis=-1)
        self.credit[1] += (came * ~better).sum(axis=-1)
        for table, at, held, guess, sure in ((self.one, last, held1, guess1, sure1), (self.two, slot, held2, guess2, sure2)):
            # Right: surer. Wrong: less sure, and replaced when not sure at all.
            table[at] = np.where(guess == out, held + (sure < _SURE), np.where(sure > 1, held - 2, out * 4))
        if learn:
            self._mix()
        return out


def _run(coder, n: int, lanes: int, most: int, ids: np.ndarray | None) -> np.ndarray:
    """All ids of a block; only the last lane may be shorter than the others."""
    length = -(-n // lanes)
    short = n - (lanes - 1) * length
    model = _Model(most, ids is None)
    out = np.zeros((length + 2, lanes), np.int64)  # two leading zeros are the context of the first id
    if ids is not None:
        out[2:] = np.append(ids, np.zeros(length * lanes - n, ids.dtype)).reshape(lanes, length).T
    due = 1
    for t in range(length):
        active = lanes if t < short else lanes - 1
        if t == due:
            model.count()
            due += max(1, due // 2)
        coded = model.step(coder, active, out[t, :active], out[t + 1, :active], None if ids is None else out[t + 2, :active], t < 16 or t % 4 == 0)
        if ids is None:
            out[t + 2, :active] = coded
    return out[2:].T.ravel()[:n]


def _checksum(ids: np.ndarray, words: np.ndarray) -> int:
    """Of a block's ids and of the words they are stored in."""
    return zlib.crc32(words.tobytes(), zlib.crc32(ids.tobytes()))


def _encode_block(ids: np.ndarray) -> bytes:
    wanted = max(1, min(LANES, len(ids) // LANE_IDS))
    lanes = -(-len(ids) // -(-len(ids) // wanted))
    coder, most = _Encoder(lanes), int(ids.max()) + 1
    _run(coder, len(ids), lanes, most, ids)
    words = coder.finish().astype("<u2")
    return _HEAD.pack(len(ids), lanes, most, _checksum(ids.astype("<u4"), words), len(words)) + words.tobytes()


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """ids (at least 0, below 2**20) as one payload of independent, checksummed blocks of at most block_ids ids."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << _MOST_BITS):
        raise ValueError("ids must be from 0 to 2**20 - 1")
    starts = range(0, len(ids), block_ids)
    return _FILE.pack(MAGIC, VERSION, len(starts)) + b"".join(_encode_block(ids[i : i + block_ids]) for i in starts)


def decode(payload: bytes) -> np.ndarray:
    """The ids of a payload as little-endian unsigned 32-bit integers; every block's checksum is compared."""
    magic, version, blocks = _FILE.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a payload of this format")
    at, out = _FILE.size, [np.empty(0, "<u4")]
    for i in range(blocks):
        try:
            n, lanes, most, crc, count = _HEAD.unpack_from(payload, at)
            words = np.frombuffer(payload, "<u2", count, at + _HEAD.size)
            ids = _run(_Decoder(lanes, words), n, lanes, most, None).astype("<u4")
        except (IndexError, ValueError, struct.error) as e:
            raise ValueError(f"block {i} is damaged") from e
        if _checksum(ids, words) != crc:
            raise ValueError(f"block {i} is damaged")
        out.append(ids)
        at += _HEAD.size + 2 * count
    return np.concatenate(out)
