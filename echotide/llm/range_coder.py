"""Adaptive context-mixing range coder for streams of token ids.

A stream is cut into blocks that are coded independently. Within a block each id
is coded from a mixture of three predictions: the id that last followed the two
ids before it (order 2), the one that last followed the id before it (order 1),
and the frequencies of ids so far (order 0). How much of the range the first two
get follows how often predictions with the same run of hits were right so far; these shares and
the frequencies are brought up to date at the places in UPDATES, predictions after every id. An
id that the frequencies don't hold yet is escaped and coded as it is. All arithmetic
is on integers, so every machine decodes alike.

Many blocks are coded at once. The encoder knows all ids, so it finds predictions and runs of
hits by sorting contexts; only the arithmetic itself goes id by id. The decoder
decodes one id of every block in each step of its loop.

Frame of a block: magic, ids, shard, block, ids of the shard before it, crc32 of the
ids, length and crc32 of the coded bytes; then these bytes. A damaged frame raises ValueError.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TCM2"
HEADER = struct.Struct("<4sIIIQIII")
BLOCK_IDS, LANES = 4096, 2048
_PLANNED = 32  # blocks that the encoder looks through at a time
_COLLECTED = 64  # steps' words that it sorts by block at a time
UPDATES = (0, 32, 96, 224, 480, 992, 1760, 2528, 3296)
_HASH, _STATES = 10, 8
#: Frequencies add up to 2^12; shares to 2^16, of which order 0 keeps 2^12 so that none of its ids is left without range.
_TOTAL, _SHARED = 12, (1 << 16) - (1 << 12)
_LOW, _DRY = (1 << 32) - 1, 1 << 32
_ESCAPE = 1 << 16
#: Before anything is known: what share a prediction gets after 0, 1, ... hits, and the weight of that in later shares.
_EXPECTED, _WEIGHT = np.array([0, 12000, 26000, 34000, 38000, 42000, 44000, 46000]), 24
_HASHED = (np.arange(1 << 16) * 40503 >> 4) & ((1 << _HASH) - 1)
#: State after one, with bit 0 for a hit: the run of hits, at most 7, and 1 after a miss.
_NEXT = np.array([(min(s, _STATES - 2) if hit else 0) + 1 for s in range(_STATES) for hit in (0, 1)], np.int32) << 16


def _shares(seen: np.ndarray) -> np.ndarray:
    """Shares by lane and state from counts of misses and hits: (lanes, states, 2)."""
    out = (seen[:, :, 1] * 56000 + _EXPECTED * _WEIGHT) // (seen.sum(2) + _WEIGHT)
    out[:, 0] = 0
    return out.astype(np.int32)


def _mixed(share1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """What order 1 gets of the range behind order 2."""
    return (share1 >> 1) * (_SHARED - w2) >> 15


def _scale(distinct: np.ndarray, seen: int) -> np.ndarray:
    """By how much, times 2^16, to multiply counts of ids; what they leave of the total is the escape's."""
    return (((1 << _TOTAL) - 1 - distinct) << 16) // (seen + distinct // 2 + 1)


def _scaled(count: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Frequencies of ids that occurred count times."""
    return (count * scale >> 16) + (count > 0)


def _contexts(ids: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id that last followed each key in its row, and the state of that prediction; 0 where there is none."""
    order = (np.argsort(keys, axis=1, kind="stable") + rows).ravel()
    k, x = keys.take(order), ids.take(order)
    known = np.zeros(k.size, bool)
    np.equal(k[1:], k[:-1], out=known[1:])
    known[rows.ravel()] = False
    hit = known.copy()
    hit[1:] &= x[1:] == x[:-1]
    at = np.arange(k.size, dtype=np.int32)
    run = at - np.maximum.accumulate(np.where(hit, np.int32(0), at))
    both = np.zeros(k.size, np.int32)
    both[1:] = x[:-1] | np.minimum(run[:-1], _STATES - 2) + 1 << 16
    both *= known
    out = np.empty(k.size, np.int32)
    out[order] = both
    out = out.reshape(ids.shape)
    return out & 0xFFFF, out >> 16


def _plan(ids: np.ndarray, start: np.ndarray, size: np.ndarray, raw: np.ndarray) -> None:
    """Start and size of each id's range out of 2^16, and whether it is escaped; ids has a block in each row, the results have one in each column."""
    lanes, steps = ids.shape
    row = np.arange(lanes, dtype=np.int32)[:, None]
    rows = np.arange(lanes)[:, None] * steps
    h = _HASHED.astype(np.uint16)[ids]
    key1, key2 = np.zeros_like(h), np.zeros_like(h)
    key1[:, 1:] = h[:, :-1]
    key2[:, 1:] = h[:, :-1]
    key2[:, 2:] += h[:, :-2] * np.uint16(1223)
    (x1, s1), (x2, s2) = (_contexts(ids, k & np.uint16((1 << _HASH) - 1), rows) for k in (key1, key2))
    # Each row's ids as numbers in ascending order.
    order = (np.argsort(ids, axis=1, kind="stable") + rows).ravel()
    x = ids.take(order)
    new = np.zeros(x.size, bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[rows.ravel()] = False
    rank = np.empty(x.size, np.int32)
    rank[order] = np.cumsum(new.reshape(ids.shape), 1, dtype=np.int32).ravel()
    width = int(rank.max(initial=0)) + 1
    rank = rank.reshape(ids.shape) + row * width
    count = np.zeros((lanes, width), np.int64)
    seen2, seen1 = np.zeros((lanes, _STATES, 2), np.int64), np.zeros((lanes, _STATES, 2), np.int64)
    cells = seen2.size
    for a, z in zip(UPDATES, (*UPDATES[1:], steps)):
        if a >= steps:
            break
        part = slice(a, min(z, steps))
        state2, state1, known = s2[:, part] + row * _STATES, s1[:, part] + row * _STATES, rank[:, part]
        w2 = _shares(seen2).take(state2)
        w1 = _mixed(_shares(seen1).take(state1), w2)
        by2 = (ids[:, part] == x2[:, part]) & (w2 > 0)
        by1 = (ids[:, part] == x1[:, part]) & (w1 > 0) & ~by2
        freq = _scaled(count, _scale((count > 0).sum(1)[:, None], a)).astype(np.int32)
        upto = np.cumsum(freq, 1, dtype=np.int32)
        f, hi = freq.take(known), upto.take(known)
        no = f == 0
        lo = np.where(no, upto[:, -1:], hi - f)
        hi[no] = 1 << _TOTAL
        base = w2 + w1
        rest = (1 << 16) - base
        lo = base + (rest * lo >> _TOTAL)
        hi = base + (rest * hi >> _TOTAL) - lo
        start[part] = np.where(by2, 0, np.where(by1, w2, lo)).T
        size[part] = np.where(by2, w2, np.where(by1, w1, hi)).T
        raw[part] = (no & ~by2 & ~by1).T
        seen2 += np.bincount((2 * state2 + by2).ravel(), minlength=cells).reshape(seen2.shape)
        # What order 2 codes doesn't count for order 1.
        seen1 += np.bincount((2 * np.where(by2, row * _STATES, state1) + by1).ravel(), minlength=cells).reshape(seen1.shape)
        count += np.bincount(known.ravel(), minlength=count.size).reshape(count.shape)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each block of ids below 65536; at most BLOCK_IDS ids in each."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list[bytes] = [b""] * len(blocks)
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for i, coded in zip(part, _encode([blocks[i] for i in part])):
            out[i] = coded
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lens = np.array([len(b) for b in blocks])
    steps, lanes = int(lens.max(initial=0)), len(blocks)
    ids = np.zeros((lanes, steps), np.uint16)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    starts, sizes, raws = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int32), np.empty((steps, lanes), bool)
    for at in range(0, lanes, _PLANNED):
        part = slice(at, at + _PLANNED)
        _plan(ids[part], starts[:, part], sizes[:, part], raws[:, part])
    # low has 48 bits and, above them, a carry into the word last put out.
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    puts: list[tuple[np.ndarray, np.ndarray]] = []  # blocks that put out a word, and the words
    runs: list[tuple[np.ndarray, np.ndarray]] = []  # of some steps, how many words each block put out, and these block by block

    def collect() -> None:
        rows = np.concatenate([r for r, _ in puts])
        runs.append((np.bincount(rows, minlength=lanes), np.concatenate([w for _, w in puts]).take(np.argsort(rows, kind="stable"))))
        puts.clear()

    def shift(rows: np.ndarray) -> None:
        if len(rows):
            a = low.take(rows)
            puts.append((rows.astype(np.uint16), (a >> 32).astype(np.int32)))
            low[rows] = (a & _LOW) << 16
            span[rows] = span.take(rows) << 16

    live = np.searchsorted(-lens, -np.arange(steps), "left").tolist()  # blocks with an id at each step
    for t, n in enumerate(live):
        part = span[:n] >> 16
        low[:n] += part * starts[t, :n].astype(np.int64)
        np.multiply(part, sizes[t, :n].astype(np.int64), out=span[:n])
        shift(np.flatnonzero(span[:n] < _DRY))
        rows = np.flatnonzero(raws[t, :n])
        if len(rows):
            part = span[rows] >> 16
            low[rows] += part * ids[rows, t]
            span[rows] = part
            shift(rows[part < _DRY])
        if len(puts) >= _COLLECTED:
            collect()
    for _ in range(3):
        puts.append((np.arange(lanes, dtype=np.uint16), (low >> 32).astype(np.int32)))
        low = (low & _LOW) << 16
    collect()
    counts = np.array([n for n, _ in runs])
    ends = np.cumsum(counts.sum(0))
    starts = (ends - counts.sum(0) + np.cumsum(counts, 0) - counts).ravel()
    counts = counts.ravel()
    out = np.empty(int(counts.sum()), np.int32)
    out[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(len(out))] = np.concatenate([w for _, w in runs])
    ends = ends.tolist()
    while len(over := np.flatnonzero(out > 0xFFFF)):
        carry = out[over] >> 16
        out[over] &= 0xFFFF
        out[over - 1] += carry
    words = out.astype("<u2")
    return [words[a:b].tobytes() for a, b in zip([0, *ends], ends)]


def decode_blocks(coded: list[bytes], lens: list[int]) -> list[np.ndarray]:
    """The ids of each block, of which there are lens."""
    order = sorted(range(len(coded)), key=lambda i: -lens[i])
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(coded)
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        for i, ids in zip(part, _decode([coded[i] for i in part], np.array([lens[i] for i in part]))):
            out[i] = ids
    return out


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place in each row's total, which of its entries it belongs to; where a row's entries begin; their ids and ranges: low end | high end << 14."""
    lanes, seen = ids.shape
    x = np.sort(ids, axis=1, kind="stable").ravel()
    new = np.ones(x.size, bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[np.arange(lanes) * seen if seen else []] = True
    at = np.flatnonzero(new)
    lane = at // max(seen, 1)
    distinct = np.bincount(lane, minlength=lanes)
    freq = _scaled(np.diff(at, append=x.size), _scale(distinct, seen)[lane])
    used = np.bincount(lane, freq, lanes).astype(np.int64)
    # The escape comes last in each lane.
    last = np.cumsum(distinct)
    freq = np.insert(freq, last, (1 << _TOTAL) - used)
    entry = np.insert(x[at].astype(np.int32), last, _ESCAPE)
    low = np.cumsum(freq) - freq & (1 << _TOTAL) - 1
    first = last - distinct + np.arange(lanes)
    number = (np.arange(len(freq)) - np.repeat(first, distinct + 1)).astype(np.uint16)
    return np.repeat(number, freq), first, entry, (low | low + freq << 14).astype(np.int32)


def _decode(coded: list[bytes], lens: np.ndarray) -> list[np.ndarray]:
    steps, lanes = int(lens.max(initial=0)), len(coded)
    sizes = [len(c) // 2 + 2 for c in coded]
    data = np.frombuffer(b"".join(c + bytes(4) for c in coded), "<u2")
    pos = np.cumsum(sizes) - sizes
    # What the code is above the low end of the range.
    over, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    for _ in range(3):
        over = over << 16 | data[pos]
        pos = pos + 1
    row = np.arange(lanes)
    tables, by_state, by_place = row << _HASH, (row * _STATES).astype(np.int32), row << _TOTAL
    table1, table2 = np.zeros(lanes << _HASH, np.int32), np.zeros(lanes << _HASH, np.int32)
    seen2, seen1 = np.zeros((lanes, _STATES, 2), np.int64), np.zeros((lanes, _STATES, 2), np.int64)
    before, before2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)  # hashes of the last ids
    hashed = _HASHED.astype(np.int32)
    ids, by_lane = np.zeros((steps, lanes), np.uint16), np.zeros((lanes, steps), np.uint16)
    marks2, marks1 = np.zeros((steps, lanes), np.uint8), np.zeros((steps, lanes), np.uint8)

    def shift(rows: np.ndarray) -> None:
        if len(rows):
            at = pos.take(rows)
            over[rows] = over.take(rows) << 16 | data.take(at)
            pos[rows] = at + 1
            span[rows] = span.take(rows) << 16

    live = np.searchsorted(-lens, -np.arange(steps), "left").tolist()
    updates, done = frozenset(UPDATES), 0
    for t, n in enumerate(live):
        if t in updates:
            for seen, marks in ((seen2, marks2), (seen1, marks1)):
                seen += np.bincount((row * (2 * _STATES) + marks[done:t]).ravel(), minlength=seen.size).reshape(seen.shape)
            by_lane[:, done:t] = ids[done:t].T
            done = t
            share2, share1 = _shares(seen2).ravel(), _shares(seen1).ravel()
            place, first, entry, ends = _frequencies(by_lane[:, :t])
        o, s, b1 = over[:n], span[:n], before[:n]
        k1, k2 = tables[:n] + b1, tables[:n] + (before2[:n] * 1223 + b1 & (1 << _HASH) - 1)
        e1, e2 = table1.take(k1), table2.take(k2)
        x1, x2, s1, s2 = e1 & 0xFFFF, e2 & 0xFFFF, e1 >> 16, e2 >> 16
        w2 = share2.take(by_state[:n] + s2)
        base = w2 + _mixed(share1.take(by_state[:n] + s1), w2)
        # Quotients of whole numbers below 2^49 whose integer part has at most 17 bits: exact in floats once cut.
        part = s >> 16
        v = (o / part).astype(np.int32)
        rest, u = (1 << 16) - base, v - base
        by2, by0 = v < w2, u >= 0
        at = first[:n] + place.take(by_place[:n] + (((np.maximum(u, 0) + 1 << _TOTAL) - 1) / rest).astype(np.int32))
        end = ends.take(at)
        start = np.where(by0, base + (rest * (end & (1 << 14) - 1) >> _TOTAL), np.where(by2, 0, w2))
        stop = np.where(by0, base + (rest * (end >> 14) >> _TOTAL), np.where(by2, w2, base))
        x = np.where(by0, entry.take(at), np.where(by2, x2, x1))
        o -= part * start.astype(np.int64)
        np.multiply(part, (stop - start).astype(np.int64), out=s)
        shift(np.flatnonzero(s < _DRY))
        raw = np.flatnonzero(x == _ESCAPE)
        if len(raw):
            part = span.take(raw) >> 16
            got = over.take(raw) // part
            over[raw] -= part * got
            span[raw] = part
            shift(raw[part < _DRY])
            x[raw] = got & 0xFFFF
        ids[t, :n] = x
        m2, m1 = s2 + s2 + (x == x2).astype(np.int32), s1 + s1 + (x == x1).astype(np.int32)
        marks2[t, :n] = m2
        marks1[t, :n] = np.where(by2, 0, m1)
        table2[k2] = x | _NEXT.take(m2)
        table1[k1] = x | _NEXT.take(m1)
        before2[:n] = b1
        before[:n] = hashed.take(x)
    by_lane[:, done:] = ids[done:].T
    return [by_lane[i, :n] for i, n in enumerate(lens)]


def frames(blocks: list[tuple[int, int, int, np.ndarray]]) -> list[bytes]:
    """Frames of (shard, block, ids of the shard before it, ids)."""
    out = []
    for (shard, block, before, ids), coded in zip(blocks, encode_blocks([b[3] for b in blocks])):
        out.append(HEADER.pack(MAGIC, len(ids), shard, block, before, zlib.crc32(np.ascontiguousarray(ids, "<u2")), len(coded), zlib.crc32(coded)) + coded)
    return out


def read_frames(data: list[bytes]) -> list[tuple[int, int, int, np.ndarray]]:
    """(shard, block, ids of the shard before it, ids) of each frame."""
    heads = []
    for f in data:
        if len(f) < HEADER.size or f[:4] != MAGIC:
            raise ValueError("not a block of coded ids")
        _, n, shard, block, before, crc, size, check = HEADER.unpack_from(f)
        coded = f[HEADER.size :]
        if len(coded) != size or zlib.crc32(coded) != check:
            raise ValueError(f"block {block} of shard {shard} is damaged")
        heads.append((n, shard, block, before, crc, coded))
    out = []
    for (n, shard, block, before, crc, _), ids in zip(heads, decode_blocks([h[5] for h in heads], [h[0] for h in heads])):
        if zlib.crc32(ids.astype("<u2")) != crc:
            raise ValueError(f"block {block} of shard {shard} decodes to other ids")
        out.append((shard, block, before, ids))
    return out
