"""Edit paths of many pairs of texts at once, by bit vectors in numpy (Myers' algorithm in blocks of 64 places).

A lane is a block of 64 places of one source; all lanes of a group of pairs step together. Blocks of a source are staggered: in a step
block w reads the destination's character number step - w, so that the step before has the difference that block w - 1 hands on. For each
place and character, two bits are kept: whether the distance grows by the place, and whether it grows by the character. The walk back
from the ends needs no more than these; it takes all pairs of a group along together, and prefers deleting, then inserting, then replacing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MATCH, REPLACE, INSERT, DELETE = range(4)
#: The bits of a group of pairs are held in so many bytes. A single pair that needs more is not for bit vectors.
TRACE_BYTES = 64 << 20
#: Fewer pairs than these are walked back one by one.
FEW = 24
#: Blocks that step together where distances alone are wanted.
LANES = 1 << 12
_ONE = np.uint64(1)
_TOP = np.uint64(63)


def trace_bytes(n: int, m: int) -> int:
    """Bytes that the bits of a pair of n and m code points take."""
    blocks = max(1, -(-n // 64))
    return 16 * blocks * (m + blocks + 1)


def groups(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Numbers of pairs that are near in size, so many together as TRACE_BYTES allow."""
    group, most = [], 0
    order = sorted(range(len(sizes)), key=lambda k: (-(-sizes[k][0] // 64), sizes[k][1]))
    for k in order:
        size = trace_bytes(*sizes[k])
        uneven = len(group) >= 64 and size > 2 * trace_bytes(*sizes[group[0]])
        if group and (uneven or max(most, size) * (len(group) + 1) > TRACE_BYTES):
            yield group
            group, most = [], 0
        group.append(k)
        most = max(most, size)
    if group:
        yield group


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows one under the other, and where they have elements."""
    inside = np.arange(width) < np.array([len(r) for r in rows])[:, None]
    out = np.zeros(inside.shape, np.uint32)
    out[inside] = np.concatenate(rows)
    return out, inside


def _numbered(src: np.ndarray, inside: np.ndarray, dst: np.ndarray, read: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A number for each pair's different source characters, at its source's and its destination's places, and the number of what a source lacks."""
    alphabet = np.zeros(0x110000, bool)
    alphabet[src[inside]] = True
    signs = np.flatnonzero(alphabet)
    if len(signs) * len(src) <= 8 * inside.size:
        lacking = len(signs) * len(src)
        code = np.full(0x110000, -1, np.int32)
        code[signs] = np.arange(len(signs))
        start = np.arange(len(src))[:, None] * len(signs)
        there = code[dst]
        return (code[src] + start)[inside], np.where(read & (there >= 0), there + start, lacking), lacking
    of = lambda x, m: ((np.arange(len(x), dtype=np.uint64)[:, None] << np.uint64(32)) | x)[m]
    keys, here = np.unique(of(src, inside), return_inverse=True)
    wanted = of(dst, read)
    near = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = np.full(dst.shape, len(keys))
    there[read] = np.where(keys[near] == wanted, near, len(keys))
    return here.ravel(), there, len(keys)


def _places(src: np.ndarray, inside: np.ndarray, dst: np.ndarray, read: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the places of each pair's different source characters, blocks of a character side by side, and by destination place and pair where its character's begin."""
    here, there, lacking = _numbered(src, inside, dst, read)
    at = np.nonzero(inside)[1]
    bits = np.zeros((lacking + 1) * blocks, np.uint64)
    # a place has a bit of its own, so that sums are unions
    np.add.at(bits, here * blocks + (at >> 6), _ONE << (at & 63).astype(np.uint64))
    return bits, np.ascontiguousarray(there.T) * blocks


def _differences(bits: np.ndarray, begins: np.ndarray, blocks: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays by step, block and pair: bits of the places by which the distance grows, and of those at which it grows by the step's character.

    They are right where the distance is band at most: blocks farther than that from the diagonal are left out and not set, and distances at
    the band's edges are taken as large as they can be.
    """
    m, pairs = begins.shape
    steps = m + blocks - 1
    down, across = np.empty((steps, blocks, pairs), np.uint64), np.empty((steps, blocks, pairs), np.uint64)
    plus, minus = np.full((blocks, pairs), ~np.uint64(0)), np.zeros((blocks, pairs), np.uint64)
    # what a block is handed by the one above it: bit 63 of that one's differences a step before. Above the first the distance always grows
    up, low = np.zeros((blocks + 1, pairs), np.uint64), np.zeros((blocks + 1, pairs), np.uint64)
    up[0] = _ONE
    block = np.arange(blocks)[:, None]
    back = begins[::-1]
    before = 0
    for step in range(steps):
        first, last = max(0, step - m + 1, -((63 + band - step) // 65)), min(blocks, step + 1, (step + band) // 65 + 1)
        if before == first > 0:
            up[first], low[first] = 1, 0
        before = first
        p, n, u, v = plus[first:last], minus[first:last], up[first:last], low[first:last]
        eq = bits.take(back[m - 1 - step + first : m - 1 - step + last] + block[first:last])
        x = eq | n
        eq |= v
        h = eq & p
        h += p
        h ^= p
        h |= eq
        hp, hn = across[step, first:last], p & h
        np.bitwise_or(h, p, out=hp)
        np.invert(hp, out=hp)
        hp |= n
        grown, shrunk = (hp << _ONE) | u, (hn << _ONE) | v
        np.right_shift(hp, _TOP, out=up[first + 1 : last + 1])
        np.right_shift(hn, _TOP, out=low[first + 1 : last + 1])
        np.bitwise_and(grown, x, out=n)
        x |= grown
        np.invert(x, out=x)
        np.bitwise_or(shrunk, x, out=p)
        down[step, first:last] = p
    return down, across


def alike(n: np.ndarray, wide: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of pairs of like length and number of diagonals, LANES blocks that step at once or one pair together; for distances()."""
    size = np.log2(n + 64).astype(np.int64)
    order = np.lexsort((wide, size))
    at = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]])
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        while start < end:
            least = int(wide[order[start]])
            until = min(end, start + max(1, LANES // (least // 64 + 2)))
            until = start + int(np.searchsorted(wide[order[start:until]], 2 * least + 256, "right"))
            yield order[start:until]
            start = until


def distances(src, dst, slack: int) -> np.ndarray:
    """The distances of pairs of waves.Texts, none empty and no source longer than its destination: the differences down and across as in _differences, of which no step is kept.

    They are right where they are no more than the difference of the lengths and slack, else perhaps too large: blocks off the diagonals that
    such scripts take are left out. Of the lowest block that reads a character, the differences across are summed up.
    """
    # long destinations first, so that pairs that are through stand last
    order = np.argsort(-dst.sizes, kind="stable")
    src, dst = src.some(order), dst.some(order)
    n, m = src.sizes, dst.sizes
    inside, read = (np.arange(int(x.max())) < x[:, None] for x in (n, m))
    a, b = np.zeros(inside.shape, np.uint32), np.zeros(read.shape, np.uint32)
    a[inside], b[read] = src.codes, dst.codes
    blocks, columns = -(-a.shape[1] // 64), b.shape[1]
    bits, begins = _places(a, inside, b, read, blocks)
    # destination places less source places of such scripts
    below, above = slack // 2 + 1, int((m - n).max()) + slack // 2 + 1
    every = np.arange(blocks)
    enter, leave = np.maximum(0, 64 * every - below), np.minimum(columns, 64 * every + 64 + above)
    plus, minus = np.full((blocks, len(n)), ~np.uint64(0)), np.zeros((blocks, len(n)), np.uint64)
    # what a block is handed by the one above it; by one that is left out, that the distance grows
    up, low = np.full((blocks + 1, len(n)), _ONE), np.zeros((blocks + 1, len(n)), np.uint64)
    block, back, out, bit = every[:, None], begins[::-1], n.astype(np.int64), ((n - 1) & 63).astype(np.uint64)
    own = (n - 1) >> 6
    # pairs by their last block, and those that go on beyond a block
    nearest, ending, deeper = int(own.min()), [np.flatnonzero(own == w) for w in every], [np.flatnonzero(own > w) for w in every]
    starts, stops = (enter + every).tolist(), (leave + every).tolist()
    first = last = 0
    for step in range(columns + blocks - 1):
        while last < blocks and starts[last] <= step:
            last += 1
        while first < last and stops[first] <= step:
            first += 1
            up[first], low[first] = 1, 0
        if step % 32 == 0:
            # pairs that some block still reads for
            on_ = int(np.searchsorted(-m, last - 1 - step, "left"))
            if not on_:
                break
        p, q, u, v = plus[first:last, :on_], minus[first:last, :on_], up[first:last, :on_], low[first:last, :on_]
        eq = bits.take(back[columns - 1 - step + first : columns - 1 - step + last, :on_] + block[first:last])
        x = eq | q
        eq |= v
        h = eq & p
        h += p
        h ^= p
        h |= eq
        hn = p & h
        hp = h
        hp |= p
        np.invert(hp, out=hp)
        hp |= q
        if last < blocks and step < starts[last] - 1:
            w = last - 1
            on = deeper[w][m[deeper[w]] > step - w]
            out[on] += (hp[w - first, on] >> _TOP).astype(np.int64) - (hn[w - first, on] >> _TOP).astype(np.int64)
        for w in range(max(first, nearest), last):
            on = ending[w]
            on = on[m[on] > step - w]
            out[on] += ((hp[w - first, on] >> bit[on]) & _ONE).astype(np.int64) - ((hn[w - first, on] >> bit[on]) & _ONE).astype(np.int64)
        grown, shrunk = (hp << _ONE) | u, (hn << _ONE) | v
        np.right_shift(hp, _TOP, out=up[first + 1 : last + 1, :on_])
        np.right_shift(hn, _TOP, out=low[first + 1 : last + 1, :on_])
        np.bitwise_and(grown, x, out=q)
        x |= grown
        np.invert(x, out=x)
        np.bitwise_or(shrunk, x, out=p)
    found = np.empty_like(out)
    found[order] = out
    return found


def _walk_each(down: np.ndarray, across: np.ndarray, a: np.ndarray, b: np.ndarray, n: list[int], m: list[int]) -> list[np.ndarray]:
    """The operations of each pair, from its end back."""
    _, blocks, pairs = down.shape
    down, across, out = memoryview(down.ravel()), memoryview(across.ravel()), []
    for who, (i, j) in enumerate(zip(n, m, strict=True)):
        x, y, ops = a[who].tolist(), b[who].tolist(), bytearray()
        while i and j:
            w, bit = i - 1 >> 6, i - 1 & 63
            cell = ((j - 1 + w) * blocks + w) * pairs + who
            if down[cell] >> bit & 1:
                ops.append(DELETE)
                i -= 1
            elif across[cell] >> bit & 1:
                ops.append(INSERT)
                j -= 1
            else:
                i -= 1
                j -= 1
                ops.append(MATCH if x[i] == y[j] else REPLACE)
        ops += bytes([DELETE]) * i + bytes([INSERT]) * j
        out.append(np.frombuffer(bytes(ops), np.uint8))
    return out


def _walk_together(down: np.ndarray, across: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Likewise, a step of all pairs at a time."""
    _, blocks, pairs = down.shape
    i, j, who = n, m, np.arange(pairs)
    length = int((n + m).max())
    out, taken = np.zeros((length, pairs), np.uint8), np.zeros(pairs, np.int64)
    wide, high = a.shape[1], b.shape[1]
    down, across, a, b = down.ravel(), across.ravel(), a.ravel(), b.ravel()
    for step in range(length):
        going = (i > 0) | (j > 0)
        if not going.all():
            i, j, who = i[going], j[going], who[going]
            if not len(who):
                break
        x, y = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        w = x >> 6
        cell = ((y + w) * blocks + w) * pairs + who
        shift = (x & 63).astype(np.uint64)
        delete = ((((down[cell] >> shift) & _ONE) != 0) | (j == 0)) & (i > 0)
        insert = ~delete & ((((across[cell] >> shift) & _ONE) != 0) | (i == 0))
        differs = a[who * wide + x] != b[who * high + y]
        op = np.where(delete, DELETE, np.where(insert, INSERT, differs)).astype(np.uint8)
        out[step, who] = op
        taken[who] += 1
        i = i - (op != INSERT)
        j = j - (op != DELETE)
    return [out[:k, c] for c, k in enumerate(taken.tolist())]


def paths(src: list[np.ndarray], dst: list[np.ndarray], band: int | None = None) -> list[np.ndarray]:
    """For each pair of arrays of code points its operations from the start, matches included, as numbers (uint8). The pairs should be near in size.

    A band about the diagonal is tried first: a path with no more edits than its half width is the one sought. Other pairs go without.
    """
    n, m = np.array([len(x) for x in src]), np.array([len(x) for x in dst])
    band = int(np.abs(n - m).max() + max(64, n.max() // 8)) if band is None else band
    a, inside = _padded(src, max(1, int(n.max())))
    b, read = _padded(dst, max(1, int(m.max())))
    blocks = -(-a.shape[1] // 64)
    down, across = _differences(*_places(a, inside, b, read, blocks), blocks, band)
    back = _walk_each(down, across, a, b, n.tolist(), m.tolist()) if len(src) < FEW else _walk_together(down, across, a, b, n, m)
    out = [ops[::-1] for ops in back]
    del down, across, back
    far = [k for k, ops in enumerate(out) if np.count_nonzero(ops) > band]
    if far:
        for k, ops in zip(far, paths([src[k] for k in far], [dst[k] for k in far], int((n + m).max())), strict=True):
            out[k] = ops
    return out
