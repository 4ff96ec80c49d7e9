import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lanewise.llm import _buckets as B
from lanewise.llm import _words as W
from lanewise.llm import components as components_module
from lanewise.llm import jaccard_join
from lanewise.llm.components import components
from lanewise.llm.jaccard_join import jaccard_components


def sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute(docs):
    s = {}
    for d, t, *_ in docs:
        s.setdefault(d, []).append(sets(t))
    parent = {d: d for d in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 90 * len(x | y) for x in s[a] for y in s[b]):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return sorted((d, len(sets(t)), root(d)) for d, t, *_ in docs)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())


def test_against_brute_force(spark, docs_of, corpus):
    assert got(docs_of(corpus, clashing=True)) == brute(corpus)


@pytest.mark.parametrize("small", [3, 16])
def test_large_group_of_near_copies(spark, docs_of, monkeypatch, small):
    """Chains of edits, so that links lead on to documents that do not link themselves."""
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", small)
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 20_000)
    r = random.Random(4)
    docs, body = [], [f"w{r.randrange(400)}" for _ in range(120)]
    for i in range(90):
        docs.append((r.randrange(10**6), " ".join(body)))
        body = list(body)
        for _ in range(r.choice([1, 1, 2, 4])):
            body[r.randrange(len(body))] = f"v{i}-{r.randrange(9)}"
    other = [f"u{r.randrange(300)}" for _ in range(100)]
    for i in range(40):
        copy = list(other)
        for _ in range(r.choice([0, 1, 3, 6])):
            copy[r.randrange(100)] = f"z{i}"
        docs.append((10**6 + i, " ".join(copy)))
    assert got(docs_of(docs)) == brute(docs)


def test_common_shingles(spark, docs_of):
    """A passage in every document, and documents that are little more than it."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, passage + " " + " ".join(f"x{r.randrange(50)}" for _ in range(r.choice([0, 1, 2, 30])))) for i in range(150)]
    assert got(docs_of(docs)) == brute(docs)


def test_odd_tables(spark, docs_of):
    assert got(docs_of([])) == []
    docs = [(3, "a"), (2, "A"), (1, "a b"), (5, "a b"), (9, None), (8, ""), (7, "q w e r"), (7, "q w e r")]
    assert got(docs_of(docs)) == brute(docs)
    rows = {(r.doc_id, r.component_id) for r in jaccard_components(docs_of([(None, "a b c"), (4, "a b c"), (None, "z")])).collect()}
    assert rows == {(None, 4), (4, 4), (None, None)}


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, monkeypatch, one_task):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(200), 1000 + r.randrange(200)) for _ in range(150)] + [(5, 5), (None, 3), (2000, 2001), (2000, 2001)]
    found = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5), one_task).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), one_task).collect() == []
    assert components_module.ONE_TASK > 0


@pytest.mark.parametrize("wide", [1, 2])
def test_group_at_the_threshold(spark, docs_of, monkeypatch, wide):
    """Very many pairs just below the threshold, over parts and blocks of tiles; with narrow
    signatures some are tried in vain, and more rounds follow."""
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    monkeypatch.setattr(jaccard_join, "SMALL_TILE", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    monkeypatch.setattr(jaccard_join, "PART", 25)
    r = random.Random(8)
    body, docs = [f"w{i}" for i in range(130)], []
    for i in range(80):
        copy = list(body)
        for at in r.sample(range(5, 125), r.choice([1, 2, 2, 3])):
            copy[at] = f"v{r.randrange(3)}"
        docs.append((i, " ".join(copy)))
    want = brute(docs)
    assert 5 < len({c for *_, c in want}) < 75
    assert got(docs_of(docs)) == want


def test_large_unlike_sets_go_no_further(spark, docs_of, monkeypatch):
    """Sets of so many shingles that 128 bits tell nothing, in tiles of common passages: none
    gets as far as wide signatures, and near copies among them still link."""
    r, calls, rest = random.Random(3), [], jaccard_join._rest
    monkeypatch.setattr(jaccard_join, "_rest", lambda *a: calls.append(a) or rest(*a))
    passages = [" ".join(f"p{i}-{j}" for j in range(120)) for i in range(100)]
    texts = [" ".join(r.sample(passages, 12)) for _ in range(200)]
    docs = [*enumerate(texts), (900, texts[7] + " end"), (901, "start " + texts[8])]
    assert got(docs_of(docs)) == brute(docs)
    assert not calls


def test_bounds_of_pairs():
    """Where two sets first meet no bound rules out a pair that links, and brief signatures don't either."""
    r, shape = random.Random(6), jaccard_join.Shape()
    texts = []
    for n in [3, 12, 40, 200, 700, 2500] * 5:
        body = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for edits in (0, max(1, n // 80), n // 60):
            for at in r.sample(range(n), edits):
                body[at] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(body[: n - r.randrange(1 + n // 100)]))
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    found = [s for b in W.blocks(batch.column("text"), W.SPACED_LOWER) for s in jaccard_join.shingle_sets(b, 3)]
    ranks = np.zeros(jaccard_join.SLOTS, np.uint16)
    ranks[np.random.default_rng(1).integers(0, len(ranks), 300_000)] = 1
    (out,) = jaccard_join._entries(shape, ranks, np.ones(2, np.uint16), 1)(iter([batch]))
    entries = B.unpacked(out.column("part"), jaccard_join.ENTRY)
    entries = entries[entries["home"] == 1]
    of = {name: entries[entries["set"] == name] for name in np.unique(entries["set"]).tolist()}
    linked = 0
    for k, s in enumerate(found):
        for t in found[k + 1 :]:
            shared, a, b = len(np.intersect1d(s, t)), jaccard_join.set_hash(s, jaccard_join._SALTS[0]), jaccard_join.set_hash(t, jaccard_join._SALTS[0])
            if a == b or 100 * shared < 90 * (len(s) + len(t) - shared):
                continue
            linked += 1
            common, i, j = np.intersect1d(of[a]["token"], of[b]["token"], return_indices=True)
            first = np.argmin(of[a]["at"][i])
            assert len(common) and jaccard_join._may_link(shape, of[a][i[first : first + 1]], of[b][j[first : first + 1]]).all()
            marks = [jaccard_join.brief(jaccard_join.signature(v), len(v)) for v in (s, t)]
            assert jaccard_join.bits_apart(*marks) <= len(s) + len(t) - 2 * shared
    assert linked > 20
