import random
import re

import pytest

from lanewise.llm import substring_dedup
from lanewise.llm.substring_dedup import cut_repeats


def brute(docs, k=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in docs]
    first = {}
    for d, w in split:
        for p in range(len(w) - k + 1):
            if d is not None:
                g = tuple(w[p : p + k])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if d is not None and first[tuple(w[p : p + k])] < d:
                gone |= set(range(p, p + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), r.kept) for r in cut_repeats(df).collect()), key=str)


@pytest.mark.parametrize("group", [300, 6 << 20])
def test_against_brute_force(spark, docs_of, corpus, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    assert got(docs_of(corpus, clashing=True)) == brute(corpus)


def test_branching_passages(spark, docs_of, monkeypatch):
    """Passages that share middles, starts and ends, over few words, so that paths branch a lot."""
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 400)
    r = random.Random(11)
    base = [r.choice("abcd") for _ in range(200)]
    docs = []
    for i in range(40):
        a = r.randrange(150)
        body = base[a : a + r.randint(5, 60)] + [r.choice("abcd") for _ in range(r.randint(0, 30))] + base[r.randrange(100) :][: r.randint(0, 40)]
        docs.append((r.randrange(10**6), " ".join(body)))
    assert got(docs_of(docs)) == brute(docs)


def test_odd_tables(spark, docs_of):
    assert got(docs_of([])) == []
    text = " ".join(map(str, range(20)))
    docs = [(1, text), (1, text), (None, text), (2, text), (3, None), (4, ""), (5, "a b")]
    assert got(docs_of(docs)) == brute(docs)


def test_repeats_within_a_document_stay(spark, docs_of):
    docs = [(1, "a b c d e f g h i j k l m " * 5), (2, "n " * 100)]
    assert got(docs_of(docs)) == brute(docs)
    assert all(x[2] == 0 for x in got(docs_of(docs)))
