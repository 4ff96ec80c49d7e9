import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import language_id as L


def all_segmentations(word, p):
    """The sum over segmentations, by recursion over prefixes."""
    best = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            piece = word[s:e]
            best[e] += best[s] * (p.get(piece, 0.0) or (L.UNKNOWN if len(piece) == 1 and piece not in p else 0.0))
    return best[-1]


def test_forward_sums_all_segmentations():
    r = random.Random(3)
    pieces = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(25)} | {"a", "b"})
    table = L.Pieces(pieces)
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    words = ["".join(r.choice("abcd") for _ in range(n)) for n in (1, 2, 5, 9, 9, 30, 64)]
    for places, codes in L.by_length(words):
        got = L.forward(L.lattice(codes, table), L.probabilities_with_none(p), len(codes))
        for row, w in zip(got, places):
            for k in (0, 1):
                assert row[k] == pytest.approx(math.log(all_segmentations(words[w], dict(zip(pieces, p[:, k])))), rel=1e-9)


def test_pieces_are_found():
    pieces = ["a", "ab", "▁the", "é", "日本"]
    table = L.Pieces(pieces)
    for i, piece in enumerate(pieces):
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = table.extend(h, np.array([ord(c)], np.uint64))
        assert table.find(h)[0] == i
    assert table.find(np.array([12345], np.uint64))[0] == len(pieces)


def test_expected_uses_add_up():
    table = L.Pieces(["a", "b", "ab"])
    (places, codes), = L.by_length(["abab"])
    p = np.array([0.3, 0.3, 0.4, 0.0])
    uses = L.expected(L.lattice(codes, table), p, np.array([2.0]))
    assert uses[0] + uses[2] == pytest.approx(4.0) and uses[1] + uses[2] == pytest.approx(4.0)


@pytest.fixture(scope="module")
def sample():
    r = random.Random(8)
    words = {"en": "the and of that house with water thing over".split(), "fr": "les des une maison avec dans cette eau même".split(), "de": "der und nicht haus mit wasser über diese größe".split()}
    docs = []
    for i in range(300):
        lang = r.choice(list(words))
        docs.append((i, " ".join(r.choice(words[lang]) for _ in range(r.randint(5, 40))), lang, "s"))
    return docs


def test_held_out_accuracy(spark, docs_of, sample):
    rows = {r.doc_id: r for r in L.identify(docs_of(sample, clashing=True)).collect()}
    truth = {d: lang for d, _, lang, _ in sample}
    held = [d for d, r in rows.items() if r.held_out]
    assert {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2} == set(held)
    assert sum(rows[d].lang_pred == truth[d] for d in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_labels_of_held_out_rows_do_not_matter(spark, docs_of, sample):
    df = docs_of(sample)
    changed = df.withColumn("lang", F.when(L.is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(x).collect()} for x in (df, changed))
    assert a == b


def test_odd_rows(spark, docs_of, sample):
    odd = [(1000, None, None, None), (1001, "", "en", "s"), (1002, "123 !? 45", None, "s"), (1003, "日本語", None, "s"), (None, "the house", None, None), (1004, "the" * 3000, "en", None), (1004, "the house", "en", None)]
    rows = L.identify(docs_of([*sample, *odd])).collect()
    of = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id >= 1000}
    assert len(rows) == len(sample) + len(odd)
    assert all(of[d].lang_pred == "und" and of[d].score == 0 for d in (1000, 1001, 1002)) and of[1003].lang_pred != "und" and of[None].lang_pred == "en"
    assert L.identify(docs_of([])).collect() == []
    assert [r.lang_pred for r in L.identify(docs_of([(1, "the house", None, None)])).collect()] == ["und"]


def test_long_words_are_summed_whole():
    """Words beyond LONGEST have the same sums, and the same expected uses, as short ones by theirs."""
    r = random.Random(5)
    pieces = ["a", "b", "ab", "ba", "aab", "bbab"]
    table, q = L.Pieces(pieces), np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    p = L.probabilities_with_none(q)
    for n in (1, 3, 7, 60, 200):
        word = "".join(r.choice("abc") for _ in range(n))
        code = L.codes_of(word)
        want = L.forward(L.lattice(code[None], table), p, 1)[0]
        assert np.allclose(L.long_forward(code, table, p), want, rtol=1e-9)
        if n == 60:
            assert np.allclose(L.long_expected(code, table, p[:, 0], 3.0), L.expected(L.lattice(code[None], table), p[:, 0], np.array([3.0])))
    assert L.long_forward(L.codes_of("ab" * 20_000), table, p).shape == (2,)


def brute_model(docs, pieces, rounds):
    """Expectation maximisation by listing every segmentation of every word."""

    def ways(word, p):
        if not word:
            return [(1.0, [])]
        out = []
        for size in range(1, len(word) + 1):
            piece = word[:size]
            v = p.get(piece, L.UNKNOWN if size == 1 else 0.0)
            out += [(v * w, [piece, *rest]) for w, rest in ways(word[size:], p)] if v else []
        return out

    learned = [(t, lang) for d, t, lang, _ in docs if lang is not None and t is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    model = {}
    for lang in sorted({x for _, x in learned}):
        words = [L.MARK + w.lower() for t, x in learned if x == lang for w in t.split()]
        p = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(rounds):
            uses = dict.fromkeys(pieces, 0.02)
            for w in words:
                every = ways(w, p)
                for v, cut in every:
                    for piece in cut:
                        if piece in uses:
                            uses[piece] += v / sum(x for x, _ in every)
            p = {k: v / sum(uses.values()) for k, v in uses.items()}
        model[lang] = p, len([1 for _, x in learned if x == lang]) / len(learned)
    return {lang: (lambda t, p=p, share=share: math.log(share) + sum(math.log(sum(v for v, _ in ways(L.MARK + w.lower(), p))) for w in t.split())) for lang, (p, share) in model.items()}


def test_prediction_against_brute_force(spark, docs_of):
    """A whole prediction: training by fold, shares, sums over segmentations, and scores."""
    r = random.Random(2)
    pieces = ["▁", "a", "b", "c", "▁a", "ab", "bc", "ca", "abc", "▁ba"]
    letters = {"x": "aab", "y": "bbc", "z": "cca"}
    docs = []
    for i in range(60):
        lang = r.choice("xyyz")
        docs.append((i, " ".join("".join(r.choice(letters[lang] + "abcd"[: r.randint(0, 4)]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 4))), lang, "s"))
    logs = brute_model(docs, pieces, L.ROUNDS)
    got = {x.doc_id: x for x in L.identify(docs_of(docs), vocabulary=pieces).collect()}
    for d, text, *_ in docs:
        each = {lang: f(text) for lang, f in logs.items()}
        best = max(each, key=each.get)
        assert got[d].lang_pred == best
        assert got[d].score == pytest.approx(1 / sum(math.exp(v - each[best]) for v in each.values()), rel=1e-6)
