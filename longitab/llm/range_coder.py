"""Adaptive range coder for token ids, in blocks that can be read by themselves.

The ids of a block are cut into lanes of equal length, which are coded in step so that one NumPy
operation serves all lanes. A symbol is predicted from the ids before it in its lane at order 2,
1 and 0, and at last by equal shares. The weights with which these predictions are mixed adapt
after every step, for each confidence of the order-2 and order-1 predictions; the predictions
adapt at steps 1, 5, 25, 125 and so on, from all ids of the block so far. Every block starts from
nothing and carries checksums of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR3"
LANES = 4096
#: Ids of a lane at least, so that short blocks have few lanes.
LANE_IDS = 512
#: Ids that are predicted at once, about, so that they and what is computed of them stay in the cache.
CHUNK = 1 << 16
_HEAD = "<4sIIIIII"  # magic, ids, lanes, steps, vocabulary, rows, crc32 of the ids
_U = np.uint64
_WORD, _MASK, _LOW = _U(32), _U((1 << 32) - 1), _U(1 << 32)
_ORDERS = 4  # order 2, 1, 0, and equal shares


def ranks(key: np.ndarray, top: int):
    """Distinct keys in order, and the rank of each key; all below ``top``. Changes ``key``."""
    n, bits = len(key), max(1, len(key)).bit_length()
    if top.bit_length() + bits < 64:
        key <<= bits
        key |= np.arange(n)
        key.sort()
        at = key & ((1 << bits) - 1)
        key >>= bits
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    new = np.zeros(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(n, np.int32)
    rank[at] = np.cumsum(new, dtype=np.int32)
    new[:1] = True
    return key.take(np.flatnonzero(new)), rank


def turned(rows: np.ndarray, tile: int = 64) -> np.ndarray:
    """The transpose, a few rows at a time, which stay in the cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for k in range(0, len(rows), tile):
        out[:, k:k + tile] = rows[k:k + tile].T
    return out


class Pairs:
    """Numbers of the pairs and triples that end at each id of ``x``, which holds one step of all lanes
    after the other; ``v`` stands for what is before a lane. Rows begin where the context changes."""

    def __init__(self, x: np.ndarray, lanes: int, v: int):
        bits = v.bit_length()
        self.one = np.concatenate((np.full(lanes, v, np.int32), x[:-lanes]))
        key, self.rank1 = ranks(joined(self.one, bits, x), v + 1 << bits)
        self.sym1, self.row1 = key & ((1 << bits) - 1), begins(key >> bits, v + 1)
        none, bits = len(key), len(key).bit_length()
        # the last pair of a triple stands for its symbol
        self.pair = np.concatenate((np.full(lanes, none, np.int32), self.rank1[:-lanes]))
        key, self.rank2 = ranks(joined(self.pair, bits, self.rank1), none + 1 << bits)
        self.last2, self.row2 = key & ((1 << bits) - 1), begins(key >> bits, none + 1)


def begins(context: np.ndarray, kinds: int) -> np.ndarray:
    """Where the rows of contexts begin, and the end; contexts are in order."""
    return np.append(0, np.cumsum(np.bincount(context, minlength=kinds)))


def joined(context: np.ndarray, bits: int, number: np.ndarray) -> np.ndarray:
    out = context.astype(np.int64)
    out <<= bits
    out |= number
    return out


def two(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers below 2^31 in one, so that they are found together."""
    return high << 32 | low


def symbols(numbers: np.ndarray, kinds: int, row: np.ndarray | None = None):
    """Begin and count of each symbol, and begin and total of each row, in one line."""
    count = np.bincount(numbers, minlength=kinds)
    line = np.zeros(kinds + 1, np.int64)
    np.cumsum(count, out=line[1:])
    line_row = line.take(row) if row is not None else None
    line <<= 32
    count |= line[:-1]
    return count if row is None else (count, two(line_row[:-1], np.diff(line_row)))


def confidence(total: np.ndarray) -> np.ndarray:
    """0 to 3; that of order 2, times 4, and that of order 1 are the state, the mixing context."""
    return (total > 0).view(np.int8) + (total > 1).view(np.int8) + (total > 3).view(np.int8)


class Predicted:
    """What the ids before ``seen`` predict."""

    def __init__(self, x: np.ndarray, pairs: Pairs, seen: int, v: int):
        self.x, self.pairs, self.seen, self.v = x, pairs, seen, v
        if seen:
            self.zero = symbols(x[:seen], v)
            self.one, self.row1 = symbols(pairs.rank1[:seen], len(pairs.sym1), pairs.row1)
            self.two, self.row2 = symbols(pairs.rank2[:seen], len(pairs.last2), pairs.row2)

    def of(self, part: slice):
        """State of the ids of a part, the order that predicts each, and its cumulative count, count and total."""
        cur, p, low = self.x[part], self.pairs, (1 << 32) - 1
        if not self.seen:
            one = np.ones(len(cur), np.int64)
            return np.zeros(len(cur), np.int8), np.full(len(cur), 3, np.int8), cur.astype(np.int64), one, self.v * one
        sym1, sym2 = self.one.take(p.rank1[part]), self.two.take(p.rank2[part])
        row1, row2 = self.row1.take(p.one[part]), self.row2.take(p.pair[part])
        total, total2 = row1 & low, row2 & low
        state = 4 * confidence(total2) + confidence(total)
        # places in the row; order 2 where it is met, by bits, so that nothing branches
        row1 ^= total
        row2 ^= total2
        sym = sym1 - row1
        sym2 -= row2
        in2 = (sym2 & low) != 0
        order = (~in2).view(np.int8)
        in2 = -in2.astype(np.int64)
        sym ^= (sym ^ sym2) & in2
        total ^= (total ^ total2) & in2
        count = sym & low
        sym >>= 32
        # the few others
        i = np.flatnonzero(count == 0)
        few = cur.take(i)
        zero = self.zero.take(few)
        no0 = (zero & low) == 0
        sym[i] = np.where(no0, few, zero >> 32)
        count[i] = np.where(no0, 1, zero & low)
        total[i] = np.where(no0, self.v, self.seen)
        order[i] = no0.view(np.int8) + np.int8(2)
        return state, order, sym, count, total


class Predictions:
    """What is needed to read on after the ids ``x``. The symbols of all orders, with their counts, stand
    in one line (order 2, 1, 0, equal shares): ``at`` finds the symbol of a place in it."""

    def __init__(self, x: np.ndarray, lanes: int, v: int):
        p, n = Pairs(x, lanes, v), len(x)
        kinds1, kinds2 = len(p.sym1), len(p.last2)
        count = np.concatenate((np.bincount(p.rank2), np.bincount(p.rank1), np.bincount(x, minlength=v), np.ones(v, np.int64)))
        line = np.append(0, np.cumsum(count))
        self.at = np.repeat(np.arange(len(count), dtype=np.int32), count)
        # begin, count, symbol, and the pair that it ends; one of a lower order ends a pair that was not met
        self.symbols = quads(line[:-1], count, np.concatenate((p.sym1.take(p.last2), p.sym1, np.arange(v), np.arange(v))),
                             np.concatenate((p.last2, np.arange(kinds1), np.full(2 * v, kinds1 + 1))))
        # begin, total (at least 1, as divisor) and share of the state, of each context
        self.order1, self.order2 = (self.contexts(line.take(r), r[-1], k, more) for r, k, more in ((p.row1 + kinds2, 1, 0), (p.row2, 4, 1)))
        self.base, self.total = np.array([0, 0, 2 * n, 3 * n]), np.array([1, 1, n, v])
        self.pair = p.rank1[-lanes:]

    @staticmethod
    def contexts(line, end, k, more):
        """``more`` contexts that were not met follow."""
        total = np.append(np.diff(line), np.zeros(more, np.int64))
        return quads(np.append(line[:-1], np.zeros(more, np.int64)), np.maximum(total, 1), k * confidence(total).astype(np.int64), 0)


def quads(*columns) -> np.ndarray:
    """Rows of four numbers of 32 bits, each found as one item of 16 bytes."""
    out = np.empty((len(columns[0]), 4), np.int32)
    for k, c in enumerate(columns):
        out[:, k] = c
    return out.view(np.complex128).ravel()


def found(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The columns of some rows."""
    return table.take(at).view(np.int32).reshape(-1, 4).T


def weights(n: np.ndarray):
    """Cumulative weights and totals of the states, flat."""
    cum = np.cumsum(n, axis=-1)
    return (cum - n).ravel(), cum[..., -1].ravel()


class Writer:
    """Ranges of all lanes. A range below 2^32 lets a word of its lane go. What is added to a lane after that
    may carry over into the word, which is made good at the end."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
        self.gone, self.moved, self.words, self.carried = np.zeros(lanes, np.int64), [], [], []

    def put(self, cum, count, total, last: bool):
        """One part of an id. Words leave after the last one; before it only where a range is short."""
        r = self.range // total
        cum = cum * r
        self.low += cum
        np.multiply(count, r, out=self.range)
        over = np.flatnonzero(self.low < cum)
        if len(over):
            self.carried.append((over, self.gone[over]))
        if last or self.range.min() < _LOW:
            i = np.flatnonzero(self.range < _LOW)
            self.moved.append(i)
            self.words.append(self.low[i] >> _WORD)
            self.gone[i] += 1
            self.low[i] <<= _WORD
            self.range[i] <<= _WORD

    def end(self) -> bytes:
        """Two words of each lane, then the others as a reader that is two words ahead moves on."""
        every = np.arange(len(self.low))
        moved = np.concatenate([*self.moved, every, every])
        words = np.concatenate([*self.words, self.low >> _WORD, self.low & _MASK])
        # 16 bits are sorted faster
        order = np.argsort(moved.astype(np.uint16) if len(every) < 1 << 16 else moved, kind="stable")
        words, lane = words[order], moved[order]
        begin = np.append(0, np.cumsum(self.gone + 2))
        if self.carried:
            lanes, gone = (np.concatenate(a) for a in zip(*self.carried))
            words += np.bincount(begin[lanes] + gone - 1, minlength=len(words)).view(_U)
        while len(over := np.flatnonzero(words > _MASK)):
            words[over] -= _LOW
            words[over - 1] += _U(1)
        words = words.astype("<u4")
        # the third word of a lane is read when its first one leaves
        ahead = np.arange(len(lane)) - begin.take(lane) >= 2
        out = np.empty(len(words) - 2 * len(every), "<u4")
        out[order[:-2][ahead[2:]]] = words[ahead]
        return words[~ahead].tobytes() + out.tobytes()


class Reader:
    """Ranges of all lanes, and where the code lies in them."""

    def __init__(self, data: bytes, lanes: int):
        self.words = np.frombuffer(data, "<u4")
        first = self.words[:2 * lanes].reshape(lanes, 2).astype(_U)
        self.range, self.code, self.at = np.full(lanes, ~_U(0)), first[:, 0] << _WORD | first[:, 1], 2 * lanes

    def look(self, total):
        self.r = self.range // total
        return (self.code // self.r).view(np.int64)

    def narrow(self, cum, count, last: bool):
        self.code -= cum * self.r
        np.multiply(count, self.r, out=self.range)
        if last or self.range.min() < _LOW:
            i = np.flatnonzero(self.range < _LOW)
            self.range[i] <<= _WORD
            self.code[i] = self.code[i] << _WORD | self.words[self.at:self.at + len(i)]
            self.at += len(i)


def segments(steps: int):
    """(begin, end) of the steps between two changes of the predictions."""
    begin, end = 0, 1
    while begin < steps:
        yield begin, min(end, steps)
        begin, end = end, end * 5


def encode_block(ids: np.ndarray, rows: bytes, n_rows: int, lanes: int = LANES) -> bytes:
    """One block: a header, the compressed row table ``rows``, and the coded ids."""
    n = len(ids)
    lanes = max(1, min(lanes, n // LANE_IDS))
    steps = -(-n // lanes)
    v = int(ids.max()) + 1 if n else 1
    table = zlib.compress(rows)
    head = struct.pack(_HEAD, MAGIC, n, lanes, steps, v, n_rows, zlib.crc32(ids.astype("<u4").tobytes()))
    x = np.zeros(lanes * steps, np.uint32)
    x[:n] = ids
    x = turned(x.reshape(lanes, steps)).ravel().view(np.int32)
    out, mix = Writer(lanes), np.ones((16, _ORDERS), np.int64)
    pairs = Pairs(x, lanes, v) if n else None
    for first, last in segments(steps):
        model = Predicted(x, pairs, first * lanes, v)
        more = max(1, CHUNK // lanes)
        for begin in range(first, last, more):
            end = min(begin + more, last)
            state, order, *coded = model.of(np.s_[begin * lanes:end * lanes])
            # the weights before each step, from the orders of the steps before it
            state = (state.reshape(-1, lanes) + np.arange(0, 16 * (end - begin), 16)[:, None]).ravel()
            choice = state * _ORDERS + order
            met = np.bincount(choice, minlength=(end - begin) * 16 * _ORDERS).reshape(-1, 16, _ORDERS)
            met = mix + 8 * np.concatenate((np.zeros_like(met[:1]), np.cumsum(met, axis=0)))
            mix, met = met[-1], met[:-1]
            cum, total = weights(met)
            share = two(cum, met.ravel()).take(choice)
            parts = [f.view(_U).reshape(-1, lanes) for f in (share >> 32, share & ((1 << 32) - 1), total.take(state), *coded)]
            for cum1, count1, total1, cum2, count2, total2 in zip(*parts):
                out.put(cum1, count1, total1, last=False)
                out.put(cum2, count2, total2, last=True)
    return head + struct.pack("<I", len(table)) + table + out.end()


def decode_block(block: bytes) -> tuple[np.ndarray, bytes, int]:
    """Ids, row table and number of rows of a block. Raises when the block is damaged."""
    magic, n, lanes, steps, v, n_rows, crc = struct.unpack_from(_HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of ids")
    size, = struct.unpack_from("<I", block, struct.calcsize(_HEAD))
    at = struct.calcsize(_HEAD) + 4
    rows = zlib.decompress(block[at:at + size])
    x = np.zeros((steps, lanes), np.int32)
    src, mix = Reader(block[at + size:], lanes), np.ones((16, _ORDERS), np.int64)
    base, total = np.empty((_ORDERS, lanes), np.int64), np.empty((_ORDERS, lanes), np.int64)
    every = np.arange(lanes)
    for begin, end in segments(steps):
        if begin:
            model = Predictions(x[:begin].ravel(), lanes, v)
            one, pair = x[begin - 1], model.pair
            base[:], total[:] = model.base[:, None], model.total[:, None]
        for t in range(begin, end):
            if begin:
                base[0], total[0], state2, _ = found(model.order2, pair)
                base[1], total[1], state1, _ = found(model.order1, one)
                state = (state2 + state1).astype(np.int64)
            else:
                state = np.zeros(lanes, np.int64)
            cum, both = weights(mix)
            seen = src.look(both.take(state).view(_U))
            order = (seen >= cum[1::_ORDERS].take(state)).view(np.int8) + (seen >= cum[2::_ORDERS].take(state)) + (seen >= cum[3::_ORDERS].take(state))
            choice = state * _ORDERS + order
            src.narrow(cum.take(choice).view(_U), mix.ravel().take(choice).view(_U), last=False)
            mix += 8 * np.bincount(choice, minlength=16 * _ORDERS).reshape(16, _ORDERS)
            if not begin:
                x[t] = one = src.look(np.full(lanes, v, _U))
                src.narrow(one.view(_U), np.ones(lanes, _U), last=True)
                continue
            which = order * np.int64(lanes) + every
            start = base.take(which)
            seen = src.look(total.take(which).view(_U))
            first, count, one, pair = found(model.symbols, model.at.take(start + seen)).astype(np.int64)
            src.narrow((first - start).view(_U), count.view(_U), last=True)
            x[t] = one
    ids = turned(x.view(np.uint32)).ravel()[:n].astype("<u4", copy=False)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("the checksum of a block of ids does not fit")
    return ids, rows, n_rows
