import re

import numpy as np
import pyarrow as pa

from lanewise.llm import _buckets as B
from lanewise.llm import _words as W

TEXTS = ["Hello, wörld  foo", "", None, "a", " \t\n ", "x-y_z 12ab", "Ünï\x0bcode\x1fend", "same same Same"]


def found(words, texts):
    out = [[] for _ in texts]
    for block in W.blocks(pa.array(texts, pa.string()), words, limit=8):
        raw = block.buf.tobytes()
        for t in range(len(block)):
            for i in range(block.word_at[t], block.word_at[t + 1]):
                out[block.first + t].append(raw[block.start[i] : block.end[i]].decode())
    return out


def test_word_classes():
    assert found(W.SPACED, TEXTS) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    assert [[low(w) for w in x] for x in found(W.ALNUM_LOWER, TEXTS)] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for t in TEXTS]


def test_hashes_depend_on_words_alone():
    by_word = {}
    for limit in (4, 1000):
        for block in W.blocks(pa.array(TEXTS * 3, pa.string()), W.SPACED, limit):
            raw = block.buf.tobytes()
            for i, h in enumerate(block.hashes.tolist()):
                assert by_word.setdefault(raw[block.start[i] : block.end[i]], h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_sliced_columns():
    column = pa.array(["zero", "one two", "three"]).slice(1, 2)
    assert sum(len(b.hashes) for b in W.blocks(column, W.SPACED)) == 3


def test_winnowing_guarantee():
    r = np.random.default_rng(1)
    h = r.integers(0, 50, 400).astype(np.uint64)
    kept = set(W.winnow(h, 4, np.ones(400, bool)).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(397))


def test_packing_round_trip():
    kind = np.dtype([("a", "<u8"), ("b", "<u4")])
    records = np.zeros(10, kind)
    records["a"] = np.arange(10)
    batch = B.packed(np.arange(10) % 3, records)
    assert batch.num_rows == 3
    assert sorted(B.unpacked(batch.column("part"), kind)["a"].tolist()) == list(range(10))
    assert B.packed(np.zeros(0, np.int64), records[:0]).num_rows == 0
