"""Edit scripts between two sequences, and texts aligned by them.

Scripts are shortest. Common prefixes are matched first, and where several shortest scripts exist the walk back from the end prefers
deleting, then inserting, then replacing, so that results do not hang on a library's choice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitvectors as B
from . import waves

REPLACE, INSERT, DELETE = "replace", "insert", "delete"
#: Beyond so many edits, sequences are cut in two at a place that a shortest script passes: history takes the square of the edits.
MOST_WAVES = 1500
#: Texts of so many code points together are aligned at once, and split into words.
SLICE, SPLIT = 1 << 21, 1 << 23


def _waves(src: Sequence, dst: Sequence, most: int) -> list[dict[int, int]] | None:
    """For 0, 1, 2 ... edits and each diagonal (source place minus destination place) the furthest source place; None beyond most edits."""
    n, m = len(src), len(dst)

    def slide(i: int, k: int) -> int:
        j = i - k
        while i < n and j < m and src[i] == dst[j]:
            i += 1
            j += 1
        return i

    waves = [{0: slide(0, 0)}]
    while waves[-1].get(n - m, -1) < n:
        if len(waves) > most:
            return None
        last, wave = waves[-1], {}
        d = len(waves)
        for k in range(max(-d, -m), min(d, n) + 1):
            i = max(last.get(k, -2) + 1, last.get(k - 1, -2) + 1, last.get(k + 1, -2))
            i = min(i, n, m + k)
            if i >= max(0, k):
                wave[k] = slide(i, k)
        waves.append(wave)
    return waves


def _last_row(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Distances of src to every prefix of dst."""
    at = np.arange(len(dst) + 1)
    row = at.copy()
    for i, c in enumerate(src):
        step = np.minimum(row[:-1] + (dst != c), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - at) + at
    return row


def edit_script(src: Sequence, dst: Sequence) -> list[tuple[str, int, int]]:
    """(operation, source place, destination place) in order. A replacement is of src[sp] by dst[dp], an insertion of dst[dp] before src[sp], a deletion of src[sp]."""
    waves = _waves(src, dst, MOST_WAVES)
    if waves is None:
        codes = {c: k for k, c in enumerate(dict.fromkeys([*src, *dst]))}
        a, b = (np.array([codes[c] for c in x], dtype=np.int64) for x in (src, dst))
        half = len(a) // 2
        cut = int(np.argmin(_last_row(a[:half], b) + _last_row(a[half:][::-1], b[::-1])[::-1])) if half else 0
        if not half:
            return [*((INSERT, 0, j) for j in range(len(dst)))] if not len(src) else _one(src, dst)
        return edit_script(src[:half], dst[:cut]) + [(op, i + half, j + cut) for op, i, j in edit_script(src[half:], dst[cut:])]
    return _walk(waves, len(src), len(dst))


def _walk(waves: list[dict[int, int]], n: int, m: int) -> list[tuple[str, int, int]]:
    """The script back through the waves of sequences of n and m elements."""
    out, k = [], n - m
    for d in range(len(waves) - 1, 0, -1):
        last = waves[d - 1]
        i = min(max(last.get(k, -2) + 1, last.get(k - 1, -2) + 1, last.get(k + 1, -2)), n, m + k)
        if last.get(k - 1, -2) + 1 >= i:
            out.append((DELETE, i - 1, i - k))
            k -= 1
        elif last.get(k + 1, -2) >= i:
            out.append((INSERT, i, i - k - 1))
            k += 1
        else:
            out.append((REPLACE, i - 1, i - 1 - k))
    return out[::-1]


def _one(src: Sequence, dst: Sequence) -> list[tuple[str, int, int]]:
    """The script of a single element against many."""
    keep = next((j for j, c in enumerate(dst) if c == src[0]), 0)
    out = [(INSERT, 0, j) for j in range(keep)]
    if dst[keep] != src[0]:
        out.append((REPLACE, 0, keep))
    return out + [(INSERT, 1, j) for j in range(keep + 1, len(dst))]


def distance(src: Sequence, dst: Sequence) -> int:
    waves = _waves(src, dst, MOST_WAVES)
    return len(waves) - 1 if waves is not None else len(edit_script(src, dst))


def _path(script: list[tuple[str, int, int]], n: int) -> np.ndarray:
    """A script for n source elements as operations with the matches between them."""
    numbers = {REPLACE: B.REPLACE, INSERT: B.INSERT, DELETE: B.DELETE}
    parts, i = [], 0
    for op, sp, _ in script:
        parts += [np.zeros(sp - i, np.uint8), np.array([numbers[op]], np.uint8)]
        i = sp + (op != INSERT)
    return np.concatenate([*parts, np.zeros(n - i, np.uint8)])


def paths(src: Sequence[str], dst: Sequence[str]) -> list[np.ndarray]:
    """For each pair of texts the operations of its edit_script with the matches between them, as numbers of bitvectors.

    Pairs go through waves in groups of like size; those with many edits for their length go through bit vectors, and those whose bits
    would not fit one by one through waves that are not all kept.
    """
    edits, out = waves.paths(waves.Texts.of(src), waves.Texts.of(dst))
    left, cut = [], []
    for k in np.flatnonzero(edits < 0).tolist():
        a, b = src[k], dst[k]
        same = len(commonprefix((a, b)))
        n, m = len(a) - same, len(b) - same
        if not n or not m:
            out[k] = np.concatenate([np.zeros(same, np.uint8), np.full(n, B.DELETE, np.uint8), np.full(m, B.INSERT, np.uint8)])
            continue
        if B.trace_bytes(n, m) > B.TRACE_BYTES:
            one = waves.path_of_one(waves.Texts.of([a]), waves.Texts.of([b]))
            out[k] = _path(edit_script(a, b), len(a)) if one is None else one
            continue
        left.append(k)
        cut.append(same)
    rest = [(B.code_points(src[k][c:]), B.code_points(dst[k][c:])) for k, c in zip(left, cut, strict=True)]
    for group in B.groups([(len(a), len(b)) for a, b in rest]):
        for g, path in zip(group, B.paths([rest[g][0] for g in group], [rest[g][1] for g in group]), strict=True):
            out[left[g]] = np.concatenate([np.zeros(cut[g], np.uint8), path])
    return out


def align_all(ocr: Sequence[str], gt: Sequence[str], gt_types: Sequence[str | None], ocr_types: Sequence[str | None]) -> list[tuple[str, str, str, str]]:
    """align for many pairs at once."""
    if not ocr:
        return []
    every = paths(ocr, gt)
    op = np.concatenate(every)
    kept, put, missing, extra = op != B.INSERT, op != B.DELETE, op == B.INSERT, op == B.DELETE
    # every path reads its own texts to their ends, so that places run on over all pairs
    i, j = np.maximum(np.cumsum(kept) - 1, 0), np.maximum(np.cumsum(put) - 1, 0)
    flat = lambda texts: np.append(B.code_points("".join(texts)), np.uint32(0))
    own = flat("W" * len(x) if t is None else t for x, t in zip(ocr, ocr_types, strict=True))[i]
    true = flat("W" * len(x) if t is None else t for x, t in zip(gt, gt_types, strict=True))[j]
    a, b = np.where(missing, ord("^"), flat(ocr)[i]), np.where(extra, ord("@"), flat(gt)[j])
    s = np.where(missing, ord("^"), np.where(op == B.MATCH, true, own))
    columns = [x.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for x in (a, b, s, np.where(extra, ord("@"), true))]
    ends = np.cumsum([len(x) for x in every]).tolist()
    return [tuple(c[start:end] for c in columns) for start, end in zip([0, *ends], ends, strict=False)]


def align(ocr: str, gt: str, gt_types: str | None = None, ocr_types: str | None = None) -> tuple[str, str, str, str]:
    """OCR text and ground truth padded to one length, and the types of both likewise.

    '^' stands in the OCR text where a ground-truth character is missing, '@' in the ground truth where the OCR text has one too many. A
    matched OCR character takes the ground truth's type, a replaced one keeps its own. Types default to 'W' everywhere.
    """
    return align_all([ocr], [gt], [gt_types], [ocr_types])[0]


def _slices(sizes: list[int], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Parts of a batch with most code points (SLICE if not given) or one row each."""
    most = SLICE if most is None else most
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    yield start, len(sizes)


def edit_script_column(ocr: Column, gt: Column) -> Column:
    """The edit script as an array of (op, sp, dp); null where a side is null."""
    names = pa.array(["", REPLACE, INSERT, DELETE])

    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        src, dst = a.to_pylist(), b.to_pylist()
        none = [x is None or y is None for x, y in zip(src, dst, strict=True)]
        ops, places, sizes = [np.zeros(0, np.uint8)], [np.zeros((2, 0), np.int32)], np.zeros(len(src), np.int32)
        fit = [k for k, gone in enumerate(none) if not gone]
        for start, end in _slices([len(src[k]) + len(dst[k]) for k in fit]):
            some = fit[start:end]
            for k, path in zip(some, paths([src[k] for k in some], [dst[k] for k in some]), strict=True):
                at = np.flatnonzero(path)
                op = path[at]
                ops.append(op)
                places.append(np.stack([np.cumsum(path != B.INSERT)[at] - (op != B.INSERT), np.cumsum(path != B.DELETE)[at] - (op != B.DELETE)]).astype(np.int32))
                sizes[k] = len(at)
        sp, dp = np.concatenate(places, axis=1)
        rows = pa.StructArray.from_arrays([names.take(pa.array(np.concatenate(ops))), pa.array(sp), pa.array(dp)], ["op", "sp", "dp"])
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, rows, mask=pa.array(none, pa.bool_()))

    return F.arrow_udf(of, "array<struct<op:string,sp:int,dp:int>>")(ocr, gt)


def aligned_column(ocr: Column, gt: Column, gt_types: Column | None = None, ocr_types: Column | None = None) -> Column:
    """The aligned texts and types as a struct; its fields are null where a text is null, or a type string's length is not its text's."""

    def of(a: pd.Series, b: pd.Series, t: pd.Series, s: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None,) * 4] * len(a)
        fits = lambda x, y, gt_t, ocr_t: x is not None and y is not None and (gt_t is None or len(gt_t) == len(y)) and (ocr_t is None or len(ocr_t) == len(x))
        fit = [k for k, row in enumerate(zip(a, b, t, s, strict=True)) if fits(*row)]
        for start, end in _slices([len(a[k]) + len(b[k]) for k in fit]):
            some = fit[start:end]
            for k, row in zip(some, align_all(*([c[k] for k in some] for c in (a, b, t, s))), strict=True):
                rows[k] = row
        return pd.DataFrame(rows, columns=["ocr_aligned", "gt_aligned", "ocr_types", "gt_types"], dtype=object)

    none = F.lit(None).cast("string")
    # named as not deterministic so that filters on the aligned texts do not align them once more
    aligning = F.pandas_udf(of, "ocr_aligned string, gt_aligned string, ocr_types string, gt_types string").asNondeterministic()
    return aligning(ocr, gt, none if gt_types is None else gt_types, none if ocr_types is None else ocr_types)


def _words_of(texts: Sequence[pa.Array]) -> list[waves.Texts]:
    """The texts with a number for each different word (by white space, as Python splits) in place of its signs; the same in all of the arrays."""
    lists = [pc.utf8_split_whitespace(pc.fill_null(t, "")) for t in texts]
    flat = pa.concat_arrays([x.flatten() for x in lists])
    some = np.asarray(pc.binary_length(flat)) > 0
    # texts that begin or end with white space have empty words there
    numbers = np.asarray(flat.dictionary_encode().indices).astype(np.uint32)[some]
    before, out, start = np.concatenate([[0], np.cumsum(some)]), [], 0
    for x in lists:
        ends = before[start + np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(x), dtype=np.int64))])]
        out.append(waves.Texts(numbers[ends[0] : ends[-1]], ends - ends[0]))
        start += int(np.asarray(pc.list_value_length(x), dtype=np.int64).sum())
    return out


def _word_distances(texts: Sequence[pa.Array], pairs: Sequence[tuple[int, int]]) -> list[pa.Array]:
    """The edits between the words of two texts each; the texts are split once for all pairs."""
    out = np.zeros((len(pairs), len(texts[0])), np.int32)
    sizes = sum(np.asarray(pc.fill_null(pc.utf8_length(t), 0)).astype(np.int64) for t in texts)
    for start, end in _slices(sizes.tolist(), SPLIT) if len(sizes) else ():
        some = [t[start:end] for t in texts]
        coded = _words_of(some)
        for k, (a, b) in enumerate(pairs):
            differ = np.flatnonzero(np.asarray(pc.fill_null(pc.not_equal(some[a], some[b]), False)))
            out[k, start + differ] = waves.distances(coded[a].some(differ), coded[b].some(differ))
    return [pa.array(found, mask=np.asarray(pc.or_(texts[a].is_null(), texts[b].is_null()))) for found, (a, b) in zip(out, pairs, strict=True)]


def with_word_distances(df: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """Columns with the edits between the words (by white space) of two text columns each; null where a side is null.

    Every different word becomes a number, so that the distance is that of edit_distance. A pair of texts may have a million different words.
    """
    columns = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    places = [(columns.index(a), columns.index(b)) for a, b in pairs.values()]

    def of(*texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_word_distances(texts, places), list(pairs))

    found = F.arrow_udf(of, ", ".join(f"`{name}` int" for name in pairs))(*(F.col(c) for c in columns))
    return df.withColumn("__word_distances", found).withColumns({name: F.col("__word_distances")[name] for name in pairs}).drop("__word_distances")


def words(text: Column) -> Column:
    """How many words a text has, by white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
