import random

import pytest

from lanewise.llm import line_dedup
from lanewise.llm.line_dedup import dedup_lines, shingle_sets


def linked(x, y, percent=80):
    s, t = (set(shingle_sets([v], line_dedup.SHINGLE)[0].tolist()) for v in (x, y))
    return 100 * len(s & t) >= percent * len(s | t)


def brute(docs, near=True):
    """Lines kept by comparing every pair of distinct lines."""
    last = 1 << 63
    places = [((d if d is not None else last), i, x) for d, t, *_ in docs for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    lines = sorted({x for *_, x in places})
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(lines if near else []):
        for y in lines[i + 1 :]:
            if root(x) != root(y) and linked(x, y):
                parent[root(x)] = root(y)
    first = {}
    for d, i, x in places:
        first[root(x)] = min(first.get(root(x), (d, i)), (d, i))
    out = []
    for d, t, *_ in docs:
        own = (t or "").split("\n")
        gone = [i for i, x in enumerate(own) if x.strip(" \t\r\x0b\x0c") and first[root(x)] != (d if d is not None else last, i)]
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(own) if i not in gone), 0 if t is None else len(own), gone))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.dropped or []) for r in dedup_lines(df).collect()), key=str)


def test_against_brute_force(spark, docs_of, corpus):
    assert got(docs_of(corpus, clashing=True)) == brute(corpus)


def test_near_lines(spark, docs_of):
    """Long lines with one word changed are well above the threshold, and are all found."""
    r = random.Random(3)
    base = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(60)) for _ in range(5)]
    docs = []
    for i in range(120):
        w = r.choice(base).split()
        w[r.randrange(60)] = f"edit{i}"
        docs.append((i, "head " + str(i) + "\n" + " ".join(w) + "\n\nfoot"))
    assert got(docs_of(docs)) == brute(docs)


def test_odd_tables(spark, docs_of):
    assert got(docs_of([])) == []
    docs = [(1, "a\nb\na"), (2, "b\n\n \nc"), (3, None), (4, ""), (None, "c\nd"), (5, "x" * 4000), (6, "\n".join(["same line"] * 500)), (7, "日本語の行です\nb")]
    assert got(docs_of(docs)) == brute(docs)


def test_repeated_rows_and_carried_columns(spark, docs_of):
    rows = dedup_lines(docs_of([(1, "p\nq"), (1, "p\nq"), (2, "q\nr")], clashing=True), carry=("source", "rest", "doc")).collect()
    assert sorted((r.doc_id, r.text, r.rest.source, r.rest.doc) for r in rows) == [(1, "p\nq", "s", "x"), (1, "p\nq", "s", "x"), (2, "r", "s", "x")]


def test_rows_without_id_are_apart(spark, docs_of):
    """A line repeated in one row takes none from the same place of other rows without id, or of the same id."""
    docs = [(1, "alpha"), (None, "first\nalpha\nthird"), (None, "fourth\nfifth\nsixth"), (7, "seventh\nalpha"), (7, "eighth\nninth"), (None, "same\nsame\nx1"), (None, "same\nsame\ny2")]
    texts = [r.text for r in dedup_lines(docs_of(docs)).collect()]
    assert {"first\nthird", "fourth\nfifth\nsixth", "seventh", "eighth\nninth"} <= set(texts)
    assert sum(t.split("\n").count("same") for t in texts) == 1


def test_short_lines_with_a_word_changed(spark, docs_of):
    """Lines of 90 to 120 characters with one word of five letters changed, and of 50 characters with one letter changed."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    docs, want = [], set()
    for i in range(20):
        w = [word() for _ in range(15 + i % 6)]
        docs += [(i, " ".join(w)), (100 + i, " ".join([*w[:7], "zzzzz", *w[8:]]))]
        w = " ".join(word() for _ in range(8)) + "ab"
        docs += [(200 + i, w), (300 + i, w[:-1] + "z")]
        want |= {i, 200 + i}
    rows = dedup_lines(docs_of(docs)).collect()
    assert {r.doc_id for r in rows if not r.dropped} == want


def test_large_group_of_similar_lines(spark, docs_of, monkeypatch):
    """Edits upon edits, over leads and blocks of bands."""
    monkeypatch.setattr(line_dedup, "SMALL_BAND", 2)
    monkeypatch.setattr(line_dedup, "BLOCK", 10)
    r, docs = random.Random(5), []
    line = [r.choice("abcdefghijklmnop ") for _ in range(150)]
    for i in range(90):
        docs.append((i, "".join(line)))
        line = list(line)
        for _ in range(r.choice([1, 2, 3, 4])):
            line[r.randrange(len(line))] = r.choice("qrstuvwxyz")
    want = brute(docs)
    assert 1 < sum(not gone for *_, gone in want) < 40
    assert got(docs_of(docs)) == want


@pytest.mark.parametrize("low, high", [(12, 20), (20, 40), (40, 60), (60, 120)])
def test_recall_of_short_lines(low, high):
    """Pairs at 0.8 or more that share a band."""
    import numpy as np

    r, hits, tries, size = random.Random(low), 0, 0, line_dedup.SHINGLE
    while tries < 400:
        x = "".join(r.choice("abcdefghijklmnop ") for _ in range(r.randint(low, high)))
        y = list(x)
        for _ in range(r.choice([1, 1, 2])):
            at = r.choice([0, len(y) - 1, r.randrange(len(y))])
            y[at : at + r.choice([0, 1])] = r.choice("qrst")
        y = "".join(y)
        if x == y or not linked(x, y):
            continue
        code = np.frombuffer((x + y).encode("utf-32-le"), "<u4")
        sig = line_dedup.signatures(code, np.array([0, len(x)]), np.array([len(x), len(x + y)]), size)
        hits, tries = hits + (sig[0] == sig[1]).reshape(line_dedup.BANDS, line_dedup.ROWS).all(axis=1).any(), tries + 1
    assert hits / tries >= 0.98


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_banding_recall(similarity):
    import numpy as np

    r, hits, tries = random.Random(7), 0, 300
    for _ in range(tries):
        n = 200
        x = "".join(r.choice("abcdefghijklmnop") for _ in range(n))
        # a run of m fresh characters changes m + 4 of n - 4 shingles on either side
        m = int((1 - similarity) / (1 + similarity) * (n - 4)) - 4
        at = r.randrange(10, n - m - 10)
        y = x[:at] + "".join(r.choice("qrstuvw") for _ in range(max(m, 1))) + x[at + max(m, 1) :]
        code = np.frombuffer((x + y).encode("utf-32-le"), "<u4")
        sig = line_dedup.signatures(code, np.array([0, n]), np.array([n, 2 * n]), line_dedup.SHINGLE)
        same = (sig[0] == sig[1]).reshape(line_dedup.BANDS, line_dedup.ROWS)
        hits += same.all(axis=1).any()
    assert hits / tries > 0.97
