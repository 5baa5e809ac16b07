"""Edit distances and shortest scripts of many pairs of texts at once, in numpy: how far so many edits reach on each diagonal.

A step adds an edit to all pairs of a group together. Eight bytes of two texts are compared at once. For scripts a pair costs the square of its edits, and
pairs with many edits for their length are left to bit vectors. For distances a few diagonals are followed, on which the edits so far and those that the
signs still need are no more than they need from the start; what is not settled so goes through bits, whose cost is the length times the diagonals over 64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bitvectors
from .bitvectors import DELETE, INSERT, REPLACE, TRACE_BYTES, trace_bytes

#: Code points of the pairs that go together, sources and destinations.
GROUP = 1 << 19
#: Reaches that are kept for the walk back, of a group and of a pair.
KEPT, KEPT_OF_ONE = 1 << 24, 1 << 22
#: So many edits beyond those that the signs need, and half of these, are first allowed for in blocks of bits.
FEW = 40
#: Diagonals of a pair that are followed at once, those of a group of pairs, and code points of the pairs whose bytes are held together.
BEAM, SIDE_BY_SIDE, TOGETHER = 8, 1 << 15, 1 << 22
#: Microseconds that a step of all diagonals costs at least; a pair by bits costs some four for a place. Smaller groups go through bits one by one.
STEP, TOO_FEW = 150, 32
#: Texts of twice as many bytes are cut to pieces of some such size, where so many bytes are the same.
PIECE, ANCHOR = 1 << 9, 16
#: Texts up to so many code points are compared by blocks of bits, a group together, where their edits are many.
BLOCKED = 1 << 12
#: A pair's reaches are kept every so many edits, and its edits followed up to so many, where all of them would not fit.
EVERY, FOLLOWED = 128, 1 << 14
_NEVER = -(1 << 29)


class Texts:
    """Code points one after the other, as bytes where all are ASCII, and where each text begins and ends."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        self.codes, self.ends = codes, ends

    @classmethod
    def of(cls, texts: Sequence[str] | pa.Array) -> Texts:
        if not isinstance(texts, pa.Array):
            joined = "".join(texts)
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
            return cls(np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), ends)
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = filled.buffers()
        ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        if not len(raw) or raw.max() < 128:
            return cls(raw, ends)
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return cls(np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), starts[ends])

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends)

    def words(self, kind: type) -> np.ndarray:
        """The eight bytes from each place on, as a number."""
        codes = np.ascontiguousarray(self.codes, dtype=kind)
        held = codes.tobytes() + bytes(8)
        return np.ndarray(len(codes) + 1, "<u8", held, strides=(codes.itemsize,)).copy()

    def text(self, k: int) -> np.ndarray:
        return self.codes[self.ends[k] : self.ends[k + 1]]

    def run(self, start: int, end: int) -> Texts:
        return Texts(self.codes[self.ends[start] : self.ends[end]], self.ends[start : end + 1] - self.ends[start])

    def some(self, which: np.ndarray) -> Texts:
        return self.spans(self.ends[which], self.sizes[which])

    def spans(self, starts: np.ndarray, sizes: np.ndarray) -> Texts:
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
        return Texts(self.codes[at], ends)

    @staticmethod
    def shorter_first(a: Texts, b: Texts) -> tuple[Texts, Texts]:
        """The shorter text of each pair and the longer one."""
        swap, pairs = a.sizes > b.sizes, len(a.sizes)
        both = Texts(np.concatenate([a.codes, b.codes]), np.concatenate([a.ends, b.ends[1:] + a.ends[-1]]))
        one, other = np.arange(pairs), np.arange(pairs) + pairs
        return both.some(np.where(swap, other, one)), both.some(np.where(swap, one, other))


def most_edits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """So many edits cost about as much as bit vectors do."""
    return 16 + 8 * np.sqrt(np.maximum(n, m)).astype(np.int64)


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of pairs near in size, GROUP code points or one pair together."""
    order = np.argsort(sizes, kind="stable")
    total = np.cumsum(sizes[order] + 1)
    start = 0
    while start < len(order):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + GROUP, "right")))
        yield order[start:end]
        start = end


def _advanced(reach: np.ndarray | None, d: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, at: np.ndarray, to: np.ndarray, per: int, shift: int) -> np.ndarray:
    """How far d edits reach by pair and diagonal, from how far one less does; three places that are never reached on either side."""

    def agree(x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        differ = a[x] ^ b[y]
        same = np.bitwise_count((differ & (np.uint64(0) - differ)) - np.uint64(1)) >> shift
        return np.minimum(same, room)

    k = np.arange(-d, d + 1, dtype=np.int32)
    limit = np.minimum(n[:, None], m[:, None] + k)
    if reach is None:
        i = np.zeros((len(n), 1), np.int32)
    else:
        i = np.minimum(np.maximum(np.maximum(reach[:, 2:-2], reach[:, 1:-3]) + 1, reach[:, 3:-1]), limit)
    fits = i >= np.maximum(k, 0)
    room = np.where(fits, limit - i, 0)
    x, y = np.where(fits, at[:, None] + i, 0), np.where(fits, to[:, None] + i - k, 0)
    step = agree(x, y, room)
    i += step
    on = np.flatnonzero((step == per) & (room > per))
    flat = i.reshape(-1)
    x, y, room = x.reshape(-1)[on] + per, y.reshape(-1)[on] + per, room.reshape(-1)[on] - per
    while len(on):
        step = agree(x, y, room)
        flat[on] += step
        more = (step == per) & (room > per)
        on, x, y, room = on[more], x[more] + per, y[more] + per, room[more] - per
    out = np.full((len(n), 2 * d + 7), _NEVER, np.int32)
    np.copyto(out[:, 3:-3], i, where=fits)
    return out


def _waves(src: Texts, dst: Texts, most: np.ndarray, keep: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each pair's edits, -1 beyond most; and if asked for, by number of edits, the pairs that have no fewer and the furthest source place on
    each diagonal (source place minus destination place), with three more on either side."""
    kind = np.uint8 if src.codes.dtype == dst.codes.dtype == np.uint8 else np.uint32
    per, shift = (8, 3) if kind is np.uint8 else (2, 5)
    a, b = src.words(kind), dst.words(kind)
    n, m, at, to = (x.astype(np.int32) for x in (src.sizes, dst.sizes, src.ends[:-1], dst.ends[:-1]))
    edits, live, history, held = np.full(len(n), -1, np.int64), np.arange(len(n)), [], 0

    reach, d = None, 0
    while len(live):
        reach = _advanced(reach, d, a, b, n, m, at, to, per, shift)
        if keep:
            history.append((live, reach))
            held += reach.size
        goal = n - m
        near = np.abs(goal) <= d
        done = near & (reach[np.arange(len(live)), np.where(near, goal, 0) + d + 3] >= n)
        edits[live[done]] = d
        left = ~done & (most[live] > d)
        if keep and held > KEPT:
            break
        if not left.all():
            live, reach, n, m, at, to = live[left], reach[left], n[left], m[left], at[left], to[left]
        d += 1
    return edits, history


def _by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """The distance by Myers' bit vectors, a source's places as the bits of one number."""
    n = len(a)
    if not n or not len(b):
        return max(n, len(b))
    order = np.argsort(a, kind="stable")
    signs, starts = np.unique(a[order], return_index=True)
    where = {}
    for sign, places in zip(signs.tolist(), np.split(order, starts[1:]), strict=True):
        bits = np.zeros(n, np.uint8)
        bits[places] = 1
        where[sign] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << n) - 1
    up, down = full, 0
    for c in b.tolist():
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right, back = down | (full & ~(xh | up)), up & xh
        right, back = (right << 1) | 1, back << 1
        up, down = (back | ~(xv | right)) & full, right & xv & full
    return len(b) + up.bit_count() - down.bit_count()


def _lanes(kind: np.dtype) -> tuple[int, int]:
    """How many signs of a kind eight bytes hold, and the shift from equal bits to equal signs."""
    return 8 // kind.itemsize, 2 + kind.itemsize.bit_length()


class _Pairs:
    """Pairs of texts one after the other, what each needs at least, and what is still needed from any two places on.

    An edit mends one sign that a side has too many of at most, so that a pair needs as many edits as it has signs that one side has more of. For the
    side where these are more, numbers counts them before each place. Signs count by their last bits.
    """

    def __init__(self, src: Texts, dst: Texts):
        kind, pairs = np.promote_types(src.codes.dtype, dst.codes.dtype), len(src.sizes)
        signs = 1 << (8 if kind.itemsize == 1 else 10)
        both = np.concatenate([src.codes, dst.codes]).astype(kind, copy=False)
        self.lanes, self.held = _lanes(kind), Texts(both, src.ends).words(kind)
        self.n, self.m, self.at, self.to = src.sizes, dst.sizes, src.ends[:-1].astype(np.int64), dst.ends[:-1] + len(src.codes)
        keys = np.repeat(np.tile(np.arange(0, pairs * signs, signs), 2), np.concatenate([self.n, self.m]))
        keys += both & (signs - 1)
        own, other = (np.bincount(k, minlength=pairs * signs).astype(np.int32) for k in (keys[: len(src.codes)], keys[len(src.codes) :]))
        more = (own - other).reshape(pairs, signs)
        over = np.maximum(more, 0).sum(axis=1)
        under = over - (self.n - self.m)
        self.least = np.maximum(over, under)
        more *= np.where(over > under, 1, -1).astype(np.int32)[:, None]
        self.numbers = np.concatenate([[0], np.cumsum((more > 0).reshape(-1)[keys], dtype=np.int32)])
        self.needed = np.where(over > under, 1, -1) * self.least

    def _alike(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
        """How many signs agree from the places on, of those that eight bytes hold and there is room for."""
        differ = self.held[x]
        differ ^= self.held[y]
        differ &= np.negative(differ)
        differ -= np.uint64(1)
        return np.minimum(np.bitwise_count(differ) >> self.lanes[1], room)

    def within(self, which: np.ndarray, most: np.ndarray, width: int) -> np.ndarray:
        """Edits that lead some pairs to their ends, -1 where most do not, or where the pairs that are left cost less by bits.

        Of each diagonal the furthest place is followed, and left where the edits so far and those still needed are too many. Where more than width
        diagonals are to be followed at once, those about the furthest place are: edits are known to be the fewest where the signs need as many.
        """
        per = self.lanes[0]
        n, m, at, to, needed = (x[which] for x in (self.n, self.m, self.at, self.to, self.needed))
        end, shifted, goal = at + n, to - at, n - m
        # needed is the difference of the counts to the ends
        needed = needed + self.numbers[at] - self.numbers[to]
        edits, live, d = np.full(len(n), -1, np.int64), np.arange(len(n)), 0
        columns, ahead = np.arange(width), np.arange(0, 8 * per, per)
        base = np.full(len(n), -1)
        reach = np.where(columns == 1, at[:, None], _NEVER)
        while True:
            # a diagonal is the source place minus the destination place
            k = base[:, None] + columns
            limit = np.minimum(end[:, None], (at + m)[:, None] + k)
            reach = np.minimum(reach, limit)
            row, col = np.nonzero(reach >= at[:, None] + np.maximum(k, 0))
            on = row * width + col
            x, kk = reach.reshape(-1)[on], k.reshape(-1)[on]
            y = x + shifted[row] - kk
            still = np.abs(needed[row] - self.numbers[x] + self.numbers[y])
            fits = np.maximum(still, np.abs(goal[row] - kk)) <= (most - d)[row]
            on, x, y, row, col = on[fits], x[fits], y[fits], row[fits], col[fits]
            room = limit.reshape(-1)[on] - x
            step = self._alike(x, y, room)
            x += step
            now = np.flatnonzero((step == per) & (room > per))
            if len(now):
                i, j, left = x[now], y[now] + per, room[now] - per
                while len(now):
                    # eight by eight bytes at a time
                    some = np.minimum(ahead, left[:, None])
                    got = self._alike(i[:, None] + some, j[:, None] + some, left[:, None] - some)
                    part = np.argmax(got < per, axis=1)
                    ends = got[np.arange(len(now)), part]
                    whole = ends == per
                    step = np.minimum(np.where(whole, per * len(ahead), ahead[part] + ends), left)
                    i += step
                    x[now] = i
                    go = np.flatnonzero(whole & (left > step))
                    now, i, j, left = now[go], i[go], j[go] + step[go], left[go] - step[go]
            done = (x == end[row]) & (kk[fits] == goal[row])
            edits[live[row[done]]] = d
            # columns of a row are in order
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            first, last = np.zeros(len(live), np.int64), np.full(len(live), -1)
            first[row[heads]] = col[heads]
            last[row[heads]] = col[np.append(heads[1:], len(row))[: len(heads)] - 1]
            open_ = (last >= 0) & (most > d)
            open_[row[done]] = False
            if not open_.any():
                return edits
            over = np.flatnonzero(open_ & (last - first + 3 > width))
            if len(over):
                far = np.full((len(live), width), _NEVER)
                far.reshape(-1)[on] = 2 * x - kk[fits] - at[row]
                first[over] = np.clip(np.argmax(far[over], axis=1) - width // 2 + 1, first[over], last[over] + 3 - width)
            wide = np.full((len(live), width + 2), _NEVER)
            wide.reshape(-1)[on + 2 * row + 1] = x
            if not open_.all():
                live, base, first, wide = live[open_], base[open_], first[open_], wide[open_]
                at, m, end, shifted, goal, most, needed = (v[open_] for v in (at, m, end, shifted, goal, most, needed))
                if STEP * int((most - d).max()) > int((m * (4 + (end - at) // 4000)).sum()):
                    # few pairs are left, which cost less by bits than so many steps
                    return edits
            d += 1
            base = base + first - 1
            taken = np.clip((first - 1)[:, None] + np.arange(width + 2), 0, width + 1)
            taken += np.arange(0, len(live) * (width + 2), width + 2)[:, None]
            wide = wide.reshape(-1)[taken]
            # by replacing from the same diagonal, by deleting from the one below, by inserting from the one above
            reach = np.maximum(np.maximum(wide[:, 1:-1], wide[:, :-2]) + 1, wide[:, 2:])


def _parts(n: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pairs with TOGETHER code points or one pair each."""
    total = np.cumsum(n + m + 512)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + TOGETHER, "right")))
        yield start, end
        start = end


def _cuts(src: Texts, dst: Texts, k: int) -> list[tuple[int, int]]:
    """Places at which both texts of a pair read the same for a while, some PIECE bytes apart, from the beginnings to the ends."""
    a, b = src.text(k), dst.text(k)
    wide, out = a.itemsize, [(0, 0)]
    piece, anchor = PIECE // wide, ANCHOR // wide
    i = piece
    data, other = a.tobytes(), b.tobytes()
    while i < len(a) - piece // 2:
        before, j = out[-1]
        # the occurrence nearest to the line from the last place to the ends
        there, room, sought = j + (i - before) * (len(b) - j) // (len(a) - before), (i - before) // 4, data[i * wide : (i + anchor) * wide]
        after = other.find(sought, there * wide, (there + room + anchor) * wide)
        at = other.rfind(sought, max(j + 1, there - room) * wide, after + 1 if after >= 0 and after - there * wide < anchor else (there + anchor) * wide)
        if at < 0 or 0 <= after and after - there * wide < there * wide - at:
            at = after
        if at >= 0 and at % wide == 0:
            out.append((i, at // wide))
            i += piece
        else:
            i += 5
    return [*out, (len(a), len(b))]


def _in_pieces(src: Texts, dst: Texts, which: np.ndarray) -> np.ndarray:
    """The edits of long pairs cut at places where both read the same, piece by piece; -1 where a piece needs more than its signs show."""
    cuts = [_cuts(src, dst, k) for k in which.tolist()]
    sides = []
    for side, texts in enumerate((src, dst)):
        starts = np.array([texts.ends[k] + c[side] for k, own in zip(which.tolist(), cuts, strict=True) for c in own[:-1]], np.int64)
        ends = np.array([texts.ends[k] + c[side] for k, own in zip(which.tolist(), cuts, strict=True) for c in own[1:]], np.int64)
        sides.append(texts.spans(starts, ends - starts))
    heads = np.concatenate([[0], np.cumsum([len(own) - 1 for own in cuts])])[:-1]
    edits, _ = _as_signs_need(*sides, cut=False)
    return np.where(np.minimum.reduceat(edits, heads) < 0, -1, np.add.reduceat(edits, heads))


def _as_signs_need(src: Texts, dst: Texts, cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's edits where a script near the furthest places has no more than the pair's signs need, else -1; and how many they need. Long texts are cut in pieces if wanted."""
    pairs = _Pairs(src, dst)
    out = np.where(np.minimum(pairs.n, pairs.m) == 0, np.maximum(pairs.n, pairs.m), -1)
    long = np.flatnonzero((out < 0) & (np.minimum(pairs.n, pairs.m) * 8 // pairs.lanes[0] > 2 * PIECE) & cut)
    if len(long):
        edits = _in_pieces(src, dst, long)
        out[long] = np.where(edits == pairs.least[long], edits, -1)
    left = np.flatnonzero(out < 0)
    left = left[np.argsort(pairs.least[left], kind="stable")]
    for start in range(0, len(left), SIDE_BY_SIDE // BEAM):
        some = left[start : start + SIDE_BY_SIDE // BEAM]
        edits = pairs.within(some, pairs.least[some], BEAM)
        out[some] = np.where(edits == pairs.least[some], edits, -1)
    return out, pairs.least


def _ranked(src: Texts, dst: Texts) -> tuple[Texts, Texts]:
    """The texts with their signs numbered, in one byte or two where there are few signs: eight or four are compared at once then."""
    if src.codes.dtype == dst.codes.dtype == np.uint8 or not len(src.codes) + len(dst.codes):
        return src, dst
    top = int(max(src.codes.max(initial=0), dst.codes.max(initial=0)))
    if top >= 1 << 24:
        return src, dst
    seen = np.zeros(top + 1, bool)
    seen[src.codes], seen[dst.codes] = True, True
    number = np.cumsum(seen) - 1
    number = number.astype(np.uint8 if number[-1] < 1 << 8 else np.uint16 if number[-1] < 1 << 16 else np.uint32)
    return Texts(number[src.codes], src.ends), Texts(number[dst.codes], dst.ends)


def distances(src: Texts, dst: Texts) -> np.ndarray:
    """The Levenshtein distance of each pair. A script that has no more edits than the pair's signs need at least is tried first; else texts of a bounded size go
    through blocks of bits about the diagonals together, and longer ones through bits one by one."""
    src, dst = _ranked(src, dst)
    n, m = src.sizes, dst.sizes
    out, least = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for start, end in _parts(n, m):
        out[start:end], least[start:end] = _as_signs_need(src.run(start, end), dst.run(start, end))
    fits = max(src.codes.max(initial=0), dst.codes.max(initial=0)) < 0x110000
    left = np.flatnonzero((out < 0) & (np.maximum(n, m) <= BLOCKED) & fits)
    apart = np.abs(n - m)
    # a script of so many edits beyond the difference of the lengths goes half as far off the way to the end's diagonal
    slack = np.zeros(len(n), np.int64)
    slack[left] = FEW + (least - apart)[left] * 3 // 2
    while len(left):
        for group in bitvectors.alike(np.minimum(n, m)[left], apart[left] + slack[left]):
            some = left[group]
            if len(some) < TOO_FEW:
                out[some] = [_by_bits(src.text(k), dst.text(k)) for k in some.tolist()]
                continue
            a, b = src.some(some), dst.some(some)
            out[some] = bitvectors.distances(*Texts.shorter_first(a, b), int(slack[some].max()))
        left = left[out[left] > apart[left] + slack[left]]
        slack[left] = out[left] - apart[left]
    for k in np.flatnonzero(out < 0).tolist():
        out[k] = _by_bits(src.text(k), dst.text(k))
    return out


def _walked(history: list[tuple[np.ndarray, np.ndarray]], edits: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By edit (from 0) and pair, the operation and its source place: back from the ends, preferring to delete, then to insert."""
    most = int(edits.max(initial=0))
    ops, places = np.zeros((most, len(n)), np.uint8), np.zeros((most, len(n)), np.int64)
    k = n - m
    for d in range(most, 0, -1):
        live, reach = history[d - 1]
        on = np.flatnonzero(edits >= d)
        row, col = np.searchsorted(live, on), k[on] + d + 2
        # a diagonal that d - 1 edits have not got to is at most one beyond theirs
        deleted, inserted = reach[row, col - 1].astype(np.int64) + 1, reach[row, col + 1].astype(np.int64)
        i = np.minimum(np.maximum(np.maximum(deleted, inserted), reach[row, col].astype(np.int64) + 1), np.minimum(n[on], m[on] + k[on]))
        op = np.where(deleted >= i, DELETE, np.where(inserted >= i, INSERT, REPLACE))
        ops[d - 1, on], places[d - 1, on] = op, i - (op != INSERT)
        k[on] += (op == INSERT).astype(np.int64) - (op == DELETE)
    return ops, places


def paths(src: Texts, dst: Texts) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each pair its edits, or -1 for pairs with many for their length, and the operations of its script with the matches between them."""
    n, m = src.sizes, dst.sizes
    edits, out = np.full(len(n), -1, np.int64), [np.zeros(0, np.uint8)] * len(n)
    # a pair's reaches are the square of its edits
    limit = int(KEPT_OF_ONE**0.5)
    most = np.where(np.array([trace_bytes(*x) for x in zip(n.tolist(), m.tolist(), strict=True)]) > TRACE_BYTES, limit, np.minimum(most_edits(n, m), limit))
    waiting = list(_groups(n + m))
    while waiting:
        group = waiting.pop()
        found, history = _waves(src.some(group), dst.some(group), most[group], keep=True)
        if len(history) <= most[group].max() and (beyond := np.flatnonzero((found < 0) & (most[group] >= len(history)))).size:
            # the reaches of all did not fit: those that are left go again, by halves
            again = group[beyond]
            if len(again) > 1:
                waiting += [again[: len(again) // 2], again[len(again) // 2 :]]
        fit = np.flatnonzero(found >= 0)
        if not len(fit):
            continue
        known = np.where(found >= 0, found, 0)
        ops, places = _walked(history, known, n[group], m[group])
        inserted = np.cumsum(ops == INSERT, axis=0)
        for k in fit.tolist():
            d = int(found[k])
            path = np.zeros(int(n[group[k]] + (inserted[d - 1, k] if d else 0)), np.uint8)
            if d:
                path[places[:d, k] + inserted[:d, k] - (ops[:d, k] == INSERT)] = ops[:d, k]
            out[group[k]] = path
        edits[group[fit]] = found[fit]
    return edits, out


def path_of_one(src: Texts, dst: Texts) -> np.ndarray | None:
    """The operations of the script of a single pair whose reaches or bits do not fit, matches included; None beyond FOLLOWED edits. Reaches are kept every
    EVERY edits, and those between are found again on the way back."""
    src, dst = _ranked(src, dst)
    kind = np.uint8 if src.codes.dtype == dst.codes.dtype == np.uint8 else np.uint32
    per, shift = (8, 3) if kind is np.uint8 else (2, 5)
    a, b = src.words(kind), dst.words(kind)
    n, m, zero = src.sizes.astype(np.int32), dst.sizes.astype(np.int32), np.zeros(1, np.int32)
    on = lambda reach, d: _advanced(reach, d, a, b, n, m, zero, zero, per, shift)
    size, other = int(n[0]), int(m[0])
    goal, reach, d, kept = size - other, on(None, 0), 0, {}
    while abs(goal) > d or reach[0, goal + d + 3] < size:
        if d == FOLLOWED:
            return None
        if d % EVERY == 0:
            kept[d] = reach
        d += 1
        reach = on(reach, d)
    ops, places, k = np.zeros(d, np.uint8), np.zeros(d, np.int64), goal
    first, between = d, []
    for e in range(d, 0, -1):
        if e - 1 < first:
            first = (e - 1) // EVERY * EVERY
            between = [kept.pop(first)]
            while len(between) < e - first:
                between.append(on(between[-1], first + len(between)))
        last, at = between[e - 1 - first][0], k + e + 2
        deleted, inserted = int(last[at - 1]) + 1, int(last[at + 1])
        i = min(max(deleted, inserted, int(last[at]) + 1), size, other + k)
        op = DELETE if deleted >= i else INSERT if inserted >= i else REPLACE
        ops[e - 1], places[e - 1] = op, i - (op != INSERT)
        k += (op == INSERT) - (op == DELETE)
    inserted = np.cumsum(ops == INSERT)
    path = np.zeros(size + (int(inserted[-1]) if d else 0), np.uint8)
    path[places + inserted - (ops == INSERT)] = ops
    return path
