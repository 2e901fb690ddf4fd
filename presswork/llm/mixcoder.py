"""Adaptive context-mixing range coder for token ids (below 65,536).

A sequence is cut into segments and these into blocks of ``BLOCK`` ids. Every block starts with a fresh model and
carries checksums, so a block is decoded with nothing but the head of its segment. ``SIDE`` blocks of a segment at a
time are coded side by side: step t codes the t-th id of all of them with numpy operations on whole arrays, one element
per block. What goes in and comes out is turned from blocks to steps and back a few steps or blocks at a time. How many
blocks stand side by side changes no byte, only the memory.

The next id is predicted by three orders:

* order 2: the id that last followed the two ids before (a hashed table), with a confidence of 0 to 7;
* order 1: the id that last followed the id before, with a confidence of 0 to 7;
* order 0: the frequencies of the ids in the segment, which its head lists; a block of a thousand ids could not
  learn a vocabulary of 50,000 anew.

The weight of order 2 is an adaptive estimate of its being right, chosen by both confidences and by whether the two
orders agree; the weight of order 1 is one of its being right when order 2 is wrong; order 0 has the rest. The
mixture is one distribution over {order 2, order 1, every id}, which drives a range coder with a 64-bit interval and
32-bit output words. All arithmetic is on integers, so encoder and decoder agree everywhere.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 1024
LANES = 8192
SIDE = 4096
#: Steps, and blocks, that are turned at once.
STEPS, TURNED = 64, 512
SLOTS = 512
MIX_BITS = 28  # of the mixed distribution: with weights below 15/16 every id has a share of at least 1
PRIOR_BITS = 20  # of the order-0 frequencies
#: Ids that are counted at once for these.
COUNTED = 1 << 19
MIX = 1 << MIX_BITS
RATE = 5
CONTEXTS = 128
HEAD = "<4sIIII"  # mark, ids, words, checksum of the ids, checksum of the words
SEGMENT = "<4sIIQ"  # mark, blocks, bytes of the packed frequencies, ids
HEAD_SIZE, SEGMENT_SIZE = struct.calcsize(HEAD), struct.calcsize(SEGMENT)
MARK, SEGMENT_MARK = b"TKB2", b"TKS2"
WORD = np.uint64(1 << 32)
LOW32 = np.uint64(0xFFFFFFFF)
#: Multipliers of the hashed contexts, modulo 2^32.
HASH_LAST, HASH_BEFORE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class Prior:
    """Order-0 frequencies: every id that occurs has at least 1 of 2^PRIOR_BITS."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.int64), freq.astype(np.int64)
        self.begin = np.zeros(1 << 16, np.int64)
        self.end = np.zeros(1 << 16, np.int64)
        ends = np.cumsum(self.freq)
        self.end[self.ids], self.begin[self.ids] = ends, ends - self.freq

    @staticmethod
    def of(ids: np.ndarray) -> "Prior":
        n = np.zeros(1 << 16, np.int64)
        for at in range(0, len(ids), COUNTED):  # numpy counts on a copy of 64-bit integers
            n += np.bincount(ids[at: at + COUNTED], minlength=1 << 16)
        seen = np.flatnonzero(n)
        total = 1 << PRIOR_BITS
        freq = 1 + n[seen] * (total - len(seen)) // n.sum()
        freq[np.argmax(freq)] += total - freq.sum()
        return Prior(seen, freq)

    def pack(self) -> bytes:
        return zlib.compress(np.concatenate((np.diff(self.ids, prepend=0), self.freq)).astype("<u4").tobytes(), 6)

    @staticmethod
    def unpack(data: bytes) -> "Prior":
        x = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(2, -1)
        return Prior(np.cumsum(x[0]), x[1])

    def inverse(self) -> np.ndarray:
        return np.repeat(self.ids.astype(np.uint16), self.freq)


class Model:
    """The orders' tables and the mixing weights of blocks side by side; row 0 is order 2, row 1 is order 1.

    Choices are made by arithmetic on masks rather than by ``np.where``, whose branches are mispredicted here."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int64)
        self.slot0 = np.stack((lane * SLOTS, (lanes + lane) * SLOTS))
        self.weight0 = lane * CONTEXTS
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)  # id * 8 + confidence
        self.weight = np.full(lanes * CONTEXTS, (1 << 14) * 0x10001, np.uint32)  # of 2^16: order 2 low, order 1 high
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.n = lanes

    def cut(self, lanes: int) -> None:
        """Go on with the first blocks only."""
        if lanes != self.n:
            self.n = lanes
            self.slot0, self.weight0 = self.slot0[:, :lanes], self.weight0[:lanes]
            self.last, self.before = self.last[:lanes], self.before[:lanes]

    def predict(self) -> None:
        """Sets the predicted ids (guess) and where order 1 and order 0 begin in the distribution."""
        h = np.empty((2, self.n), np.uint32)
        np.multiply(self.last, HASH_LAST, out=h[1])
        np.multiply(self.before, HASH_BEFORE, out=h[0])
        h[0] += h[1]
        h[0] >>= 18
        h[1] >>= 16
        h &= SLOTS - 1
        self.at = self.slot0 + h.view(np.int32)
        self.entry = self.table.take(self.at, mode="clip")
        self.guess = self.entry >> 3
        self.sure = self.entry & 7
        same = self.guess[0] == self.guess[1]
        self.k = self.weight0 + ((self.sure[0] << 4) + (self.sure[1] << 1) + same)
        both = self.weight.take(self.k, mode="clip")
        self.p = np.empty((2, self.n), np.int32)
        np.bitwise_and(both, 0xFFFF, out=self.p[0].view(np.uint32))
        np.right_shift(both, 16, out=self.p[1].view(np.uint32))
        p = np.maximum(self.p, 64)
        np.minimum(p, 61440, out=p)
        p[1] *= ~same
        one = p[0] << (MIX_BITS - 16)
        share = (MIX - one).astype(np.int64)
        share *= p[1]
        share >>= 16
        self.one = one.astype(np.int64)
        self.zero = self.one + share
        self.room = MIX - self.zero

    def interval(self, prior: Prior, x: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of the ids ``x`` in the distribution."""
        begin = prior.begin.take(x, mode="clip")
        end = prior.end.take(x, mode="clip")
        for edge in (begin, end):
            edge *= self.room
            edge >>= PRIOR_BITS
            edge += self.zero
        # order 2 stands at [0, one), order 1 at [one, zero)
        first = hit[0]
        plain = ~(first | hit[1])
        begin *= plain
        begin += (hit[1] & ~first) * self.one
        end *= plain
        end += first * self.one
        end += (hit[1] & ~first) * self.zero
        return begin, end - begin

    def update(self, x: np.ndarray, hit: np.ndarray) -> None:
        """``x`` are the ids (32 bits) that came, ``hit`` tells which orders predicted them."""
        hits = hit.astype(np.int32)
        p = self.p
        change = hits * 65535
        change -= p
        change >>= RATE
        change[1] *= ~hit[0]
        p += change
        p[1] <<= 16
        self.weight[self.k] = (p[0] | p[1]).view(np.uint32)
        sure = self.sure
        # a hit adds 1 up to 7, a miss halves; where nothing was sure the new id stands with confidence 1
        less = (sure >> 1) - sure
        hits *= (sure < 7) - less
        less += hits
        less += self.entry
        less += (sure == 0) * ((x << 3) + 1 - less)
        self.table[self.at] = less
        self.before, self.last = self.last, x.view(np.uint32)


def segments(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES):
    """The bytes of the segments of a sequence of ids, piece by piece."""
    ids = np.ascontiguousarray(ids, np.uint16)
    for at in range(0, len(ids), block * lanes):
        part = ids[at: at + block * lanes]
        prior = Prior.of(part)
        packed = prior.pack()
        yield struct.pack(SEGMENT, SEGMENT_MARK, -(-len(part) // block), len(packed), len(part)) + packed
        for i in range(0, len(part), block * SIDE):
            yield from _encode(part[i: i + block * SIDE], prior, block)


def _encode(ids: np.ndarray, prior: Prior, block: int):
    """The bytes of some blocks at a time."""
    n = -(-len(ids) // block)
    last = len(ids) - (n - 1) * block
    full = ids[: len(ids) // block * block].reshape(-1, block)
    short = np.zeros(block if last < block else 0, np.uint16)
    short[:last] = ids[full.size:]
    m = Model(n)
    low, width = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    # a row per word: blocks advance at about the same pace, so that a step touches few rows
    words, count = np.zeros((block + 4, n), np.uint32), np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        for t in range(min(block, len(ids))):
            if t == last:  # only the last block can be shorter
                m.cut(n - 1)
            if not m.n:
                break
            if t % STEPS == 0:
                steps = np.zeros((min(STEPS, block - t), n), np.uint16)
                steps[:, : len(full)] = full[:, t: t + STEPS].T
                if len(short):
                    steps[:, -1] = short[t: t + STEPS]
            x = steps[t % STEPS, : m.n].astype(np.int32)
            m.predict()
            hit = m.guess == x
            begin, size = m.interval(prior, x, hit)
            lo, wi = low[: m.n], width[: m.n]
            wi >>= np.uint64(MIX_BITS)
            lo += wi * begin.view(np.uint64)
            wi *= size.view(np.uint64)
            need = np.flatnonzero(wi < WORD)
            if len(need):
                a = lo[need]
                words.ravel()[count[need] * n + need] = a >> np.uint64(32)
                count[need] += 1
                # an interval across a word's border is cut at the border
                wi[need] = np.minimum(wi[need], WORD - (a & LOW32)) << np.uint64(32)
                lo[need] = a << np.uint64(32)
            m.update(x, hit)
    del m
    for at in range(0, n, TURNED):
        own_words, out = words[: count.max() + 2, at: at + TURNED].T.copy(), []
        for row, i in enumerate(range(at, min(n, at + TURNED))):
            end = int(count[i])
            own_words[row, end], own_words[row, end + 1] = int(low[i]) >> 32, int(low[i]) & 0xFFFFFFFF
            body = own_words[row, : end + 2].astype("<u4").tobytes()
            own = ids[i * block: (i + 1) * block]
            out.append(struct.pack(HEAD, MARK, len(own), end + 2, zlib.crc32(own.astype("<u4").tobytes()), zlib.crc32(body)) + body)
        yield b"".join(out)


def read_segment(data: bytes, at: int = 0) -> tuple[int, Prior, list[bytes]]:
    """(end, frequencies, blocks) of the segment at byte ``at``; nothing is decoded."""
    mark, n, size, _ = struct.unpack_from(SEGMENT, data, at)
    if mark != SEGMENT_MARK:
        raise ValueError(f"no segment at byte {at}")
    at += SEGMENT_SIZE
    prior = Prior.unpack(data[at: at + size])
    at += size
    blocks = []
    for _ in range(n):
        mark, _, words, _, _ = struct.unpack_from(HEAD, data, at)
        if mark != MARK:
            raise ValueError(f"no block at byte {at}")
        end = at + HEAD_SIZE + 4 * words
        blocks.append(data[at:end])
        at = end
    return at, prior, blocks


def decode(prior: Prior, blocks: list[bytes]) -> np.ndarray:
    """The ids of some blocks of a segment, in their order; ValueError if a checksum fails."""
    return np.concatenate([np.zeros(0, np.uint16), *decoded(prior, blocks)])


def decoded(prior: Prior, blocks: list[bytes]):
    """What ``decode`` gives, in parts: the ids of some blocks at a time."""
    for at in range(0, len(blocks), SIDE):
        yield from _decode(prior, blocks[at: at + SIDE])


def _decode(prior: Prior, blocks: list[bytes]):
    heads = []
    for b in blocks:
        mark, size, words, crc, body = struct.unpack_from(HEAD, b)
        if mark != MARK or len(b) != HEAD_SIZE + 4 * words or zlib.crc32(b[HEAD_SIZE:]) != body:
            raise ValueError("damaged block")
        heads.append((size, words, crc))
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])  # blocks that end first stand last
    sizes = np.array([heads[i][0] for i in order])
    n, longest = len(blocks), int(sizes[0])
    words = np.empty((max(h[1] for h in heads) + 4, n), np.uint32)  # a row per word, as in _encode
    for at in range(0, n, TURNED):
        own_words = np.zeros((min(n - at, TURNED), len(words)), np.uint32)
        for row, i in enumerate(order[at: at + TURNED]):
            own_words[row, : heads[i][1]] = np.frombuffer(blocks[i], "<u4", heads[i][1], HEAD_SIZE)
        words[:, at: at + TURNED] = own_words.T
    inverse = prior.inverse()
    steps = np.zeros((longest, n), np.uint16)
    m = Model(n)
    low, width = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = words[0].astype(np.uint64) << np.uint64(32) | words[1].astype(np.uint64)
    count = np.full(n, 2, np.int64)
    ends = np.searchsorted(-sizes, -np.arange(longest), side="left")  # how many blocks have more than t ids
    with np.errstate(over="ignore"):
        for t in range(longest):
            m.cut(int(ends[t]))
            lo, wi, co = low[: m.n], width[: m.n], code[: m.n]
            m.predict()
            wi >>= np.uint64(MIX_BITS)
            value = np.minimum((co - lo) // wi, np.uint64(MIX - 1)).view(np.int64)
            v = np.maximum(value - m.zero, 0)
            # below 2^49, so that a quotient of doubles has the right whole part
            v += 1
            v <<= PRIOR_BITS
            v -= 1
            x = inverse.take((v / m.room).astype(np.int64), mode="clip").astype(np.int32)
            two = value < m.one
            one = (value < m.zero) & ~two
            x += one * (m.guess[1] - x)
            x += two * (m.guess[0] - x)
            hit = m.guess == x
            begin, size = m.interval(prior, x, hit)
            lo += wi * begin.view(np.uint64)
            wi *= size.view(np.uint64)
            need = np.flatnonzero(wi < WORD)
            if len(need):
                a = lo[need]
                co[need] = co[need] << np.uint64(32) | words.ravel()[count[need] * n + need]
                count[need] += 1
                wi[need] = np.minimum(wi[need], WORD - (a & LOW32)) << np.uint64(32)
                lo[need] = a << np.uint64(32)
            steps[t, : m.n] = x
            m.update(x, hit)
    del m, words
    rows = np.empty(n, np.int64)
    rows[order] = np.arange(n)
    for at in range(0, n, TURNED):
        out = []
        for i, own in zip(range(at, n), steps[:, rows[at: at + TURNED]].T.copy()):
            own = own[: heads[i][0]]
            if zlib.crc32(own.astype("<u4").tobytes()) != heads[i][2]:
                raise ValueError("a block's ids do not match their checksum")
            out.append(own)
        yield np.concatenate(out)
