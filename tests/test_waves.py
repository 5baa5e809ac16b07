"""Distances and scripts of many pairs at once are those of the pairs one by one."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from quillspark.functions import bitvectors, editing, waves
from quillspark.functions.waves import Texts

RANDOM = random.Random(5)


def changed(text, part, alphabet):
    out = []
    for c in text:
        x = RANDOM.random() / max(part, 1e-9)
        out.append(RANDOM.choice(alphabet) if x < 1 else "" if x < 1.5 else c + RANDOM.choice(alphabet) if x < 2 else c)
    return "".join(out)


def some_pairs(alphabet, n=150):
    src = ["".join(RANDOM.choices(alphabet, k=RANDOM.choice([0, 1, 3, 20, 90, 250]))) for _ in range(n)]
    return src, [changed(s, RANDOM.choice([0, 0.02, 0.1, 0.5]), alphabet) for s in src]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "aé漢𝒳b"])
@pytest.mark.parametrize("few", [0, 40])
def test_distances(monkeypatch, alphabet, few):
    monkeypatch.setattr(waves, "FEW", few)
    src, dst = some_pairs(alphabet)
    want = [len(editing._waves(a, b, 10**6)) - 1 for a, b in zip(src, dst, strict=True)]
    assert waves.distances(Texts.of(src), Texts.of(dst)).tolist() == want
    cut = lambda x: pa.array(["zz", *x])[1:]
    assert waves.distances(Texts.of(cut(src)), Texts.of(cut(dst))).tolist() == want
    assert [waves._by_bits(Texts.of(src).text(k), Texts.of(dst).text(k)) for k in range(len(src))] == want


@pytest.mark.parametrize("kept", [1 << 24, 3000])
def test_paths(monkeypatch, kept):
    monkeypatch.setattr(waves, "KEPT", kept)
    src, dst = some_pairs("abcd ")
    edits, paths = waves.paths(Texts.of(src), Texts.of(dst))
    assert (edits >= 0).mean() > 0.7
    for k in np.flatnonzero(edits >= 0).tolist():
        a, b = src[k], dst[k]
        assert np.array_equal(paths[k], editing._path(editing._walk(editing._waves(a, b, 10**6), len(a), len(b)), len(a)))


def test_long_lines_with_many_edits():
    """Sixty lines of 30,000 characters, 1,500 of them changed: bands about the diagonal took some 2,500 million places of each eight lines."""
    src = ["".join(RANDOM.choices("abcdefgh ", k=30_000)) for _ in range(60)]
    dst = ["".join("1" if k % 20 == 7 else c for k, c in enumerate(s)) for s in src]
    start = time.process_time()
    assert waves.distances(Texts.of(src), Texts.of(dst)).tolist() == [1500] * 60
    assert time.process_time() - start < 30


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "aé漢𝒳b"])
def test_distances_by_blocks_of_bits(monkeypatch, alphabet):
    src, dst = some_pairs(alphabet, 400)
    src, dst = src + dst, dst + src[::-1]
    want = [len(editing._waves(a, b, 10**6)) - 1 for a, b in zip(src, dst, strict=True)]
    monkeypatch.setattr(waves, "FEW", 0)
    monkeypatch.setattr(bitvectors, "LANES", 64)
    assert waves.distances(Texts.of(src), Texts.of(dst)).tolist() == want


@pytest.mark.parametrize("every", [1, 7, 128])
def test_path_of_one(monkeypatch, every):
    monkeypatch.setattr(waves, "EVERY", every)
    for a, b in zip(*some_pairs("abcdé ", 60), strict=True):
        want = editing._path(editing._walk(editing._waves(a, b, 10**6), len(a), len(b)), len(a))
        assert np.array_equal(waves.path_of_one(Texts.of([a]), Texts.of([b])), want)
    monkeypatch.setattr(waves, "FOLLOWED", 3)
    assert waves.path_of_one(Texts.of(["aaaaa"]), Texts.of(["bbbbb"])) is None


def test_a_long_line_with_more_edits_than_are_kept():
    """34,000 characters with some 2,300 edits: the waves of dictionaries that such a line went through took 20 seconds, as long as 14,000 other lines together."""
    src = "".join(RANDOM.choices("abcdefgh ", k=34_000))
    dst = "".join("" if k % 15 == 7 else c for k, c in enumerate(src))
    start = time.process_time()
    [path] = editing.paths([src], [dst])
    assert np.count_nonzero(path) == len(src) - len(dst) and time.process_time() - start < 6


def test_many_lines_with_many_edits():
    """2,000 lines of 400 characters, of which one in eight is another: waves took twice the time of blocks of bits, or more."""
    src = ["".join(RANDOM.choices("abcdefgh ", k=400)) for _ in range(2000)]
    dst = ["".join("↷" if k % 8 == 7 else c for k, c in enumerate(s)) for s in src]
    assert waves.distances(Texts.of(src), Texts.of(dst)).tolist() == [50] * 2000


def test_lines_of_all_lengths_whose_signs_show_their_edits():
    """1,000 lines of 360 to 3,357 characters in which signs of their own were put in and letters read wrong: blocks of bits by small groups took some three times as long."""
    put = "[$^*&%#@!~+=|<>]"
    src = ["".join(RANDOM.choices("abcdefgh ", k=360 + 3 * k)) for k in range(1000)]
    dst = ["".join("X" if k % 45 == 9 else c + put * (k % 90 == 50) for k, c in enumerate(s)) for s in src]
    start = time.process_time()
    assert waves.distances(Texts.of(src), Texts.of(dst)).tolist() == [16 * ((len(s) + 39) // 90) + (len(s) + 35) // 45 for s in src]
    assert time.process_time() - start < 3.5


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh 1", "aé漢𝒳b"])
@pytest.mark.parametrize("few", [0, 32])
def test_distances_of_longer_texts(monkeypatch, alphabet, few):
    """In pieces, about the diagonals, and by bits: as by bits one by one."""
    monkeypatch.setattr(waves, "TOO_FEW", few)
    src = ["".join(RANDOM.choices(alphabet, k=RANDOM.choice([100, 700, 1500, 3000]))) for _ in range(60)]
    dst = [changed(s, RANDOM.choice([0.01, 0.1, 0.5]), alphabet) for s in src]
    dst = [d.replace("aa", "a$x_1$") if k % 3 == 0 else d[len(d) // 3 :] if k % 7 == 0 else d for k, d in enumerate(dst)]
    a, b = Texts.of(src), Texts.of(dst)
    assert waves.distances(a, b).tolist() == waves.distances(b, a).tolist() == [waves._by_bits(a.text(k), b.text(k)) for k in range(len(src))]


def test_words_are_split_as_python_does():
    texts = ["a  b\u2003c", " a\x1cb ", "", " ", None, "c\u00a0a b", "\u200bx\x85a"]
    one, other = editing._words_of([pa.array(texts), pa.array(texts[::-1])])
    named = {n: w for k, t in enumerate(texts) for n, w in zip(one.text(k).tolist(), (t or "").split(), strict=True)}
    assert len(set(named.values())) == len(named)
    assert all([named[n] for n in x.text(k).tolist()] == (t or "").split() for x, own in ((one, texts), (other, texts[::-1])) for k, t in enumerate(own))
