import os
import random
import time

import public_tokenizers as P
import pytest
import tiktoken

from quillspark.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCRIPTS = {"latin": (0x61, 0x7B), "cyrillic": (0x430, 0x450), "chinese": (0x4E00, 0x9FA5), "devanagari": (0x905, 0x940), "emoji": (0x1F600, 0x1F640)}


@pytest.fixture(scope="module")
def both():
    c = bpe.Codec(RANKS, P.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@pytest.mark.parametrize("script", SCRIPTS)
def test_long_words_of_every_script(both, script, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    c, library = both
    rng, (low, high) = random.Random(script), SCRIPTS[script]
    words = ["".join(chr(rng.randrange(low, high)) for _ in range(n)) for n in (1, 5, 12, 13, 40, 300) for _ in range(60)]
    words += ["".join(chr(low) * 900), *("".join(chr(rng.randrange(low, high)) for _ in range(300)) for _ in range(600))]
    began = time.process_time()
    ids, cut = c.encode(words)
    # some 0.6 MB of different words, most near a thousand bytes long
    assert time.process_time() - began < 8
    assert all(ids[cut[k] : cut[k + 1]].tolist() == library.encode_ordinary(w) for k, w in enumerate(words))
    raw, ends = c.decode_runs(*c.runs(words))
    assert all(raw[ends[k] : ends[k + 1]].tobytes() == w.encode() for k, w in enumerate(words))
    assert os.listdir(tmp_path) == []


def test_no_token_lies_across_a_cut(both):
    c, _ = both
    for token in c.ranks:
        if len(token) > 1:
            assert c.parts(token) == [token]


def test_memo_keeps_frequent_words(both, monkeypatch):
    c, library = bpe.Codec(RANKS, P.PATTERN), both[1]
    monkeypatch.setattr(bpe, "MEMO_WORDS", 40)
    rng = random.Random(3)
    for k in range(12):
        texts = [" common words here " * 3 + " ".join(f"own{rng.randrange(10**6)}" for _ in range(8)) for _ in range(3)]
        ids, cut = c.encode(texts)
        assert all(ids[cut[i] : cut[i + 1]].tolist() == library.encode_ordinary(t) for i, t in enumerate(texts))
        if k % 2:
            raw, ends = c.decode_runs(*c.runs(texts))
            assert all(raw[ends[i] : ends[i + 1]].tobytes() == t.encode() for i, t in enumerate(texts))
    assert {" common", " words", " here"} <= set(c.index) and len(c.index) < 120
