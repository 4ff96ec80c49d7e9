"""Texts of more than a megabyte, which pass the size of a block, in every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import topk_search
from lanewise.llm.decontamination import decontaminate
from lanewise.llm.jaccard_join import jaccard_components
from lanewise.llm.language_id import identify
from lanewise.llm.license_scan import scan_licenses
from lanewise.llm.line_dedup import dedup_lines
from lanewise.llm.mixing import mix_sources
from lanewise.llm.quality import classify
from lanewise.llm.secret_scan import scan_secrets
from lanewise.llm.substring_dedup import cut_repeats

WORDS = 170_000


@pytest.fixture(scope="module")
def long_words():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(30_000)]
    out = [r.choice(vocabulary) for _ in range(WORDS)]
    assert len(" ".join(out)) > 1 << 20
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_decontamination(spark, docs_of, long_words):
    item = [f"item{i}" for i in range(30)]
    docs = docs_of([(1, " ".join(long_words + item)), (2, " ".join(long_words)), (3, " ".join(item[3:12]))])
    rows = by_id(decontaminate(docs, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"), min_items=1))
    assert [(rows[d].n_words, rows[d].n_hit, rows[d].contaminated) for d in (1, 2, 3)] == [(WORDS + 30, 30, True), (WORDS, 0, False), (9, 9, True)]


def test_lines(spark, docs_of, long_words):
    line = " ".join(long_words)
    rows = by_id(dedup_lines(docs_of([(1, line + "\nfirst"), (2, "second\n" + line[:-1] + "!"), (3, "\n".join(long_words[:5]) + "\n" + line)])))
    assert rows[1].dropped is None and rows[2].dropped == [1] and rows[2].text == "second" and rows[3].dropped == [5]


def test_mixing(spark, docs_of, long_words):
    rows = by_id(mix_sources(docs_of([(1, " ".join(long_words), "en", "a"), (2, "one two", "en", "b")])))
    assert rows[1].size == WORDS and sum(r.taken for r in rows.values()) == (WORDS + 2) * 3 // 2 and rows[2].taken == 4


def test_language(spark, docs_of, long_words):
    docs = [(i, "the house and the river over there" if i % 2 else "la maison avec une rivière dans cette", "en" if i % 2 else "fr") for i in range(40)]
    rows = by_id(identify(docs_of([(*d, "s") for d in docs] + [(100, " ".join(long_words) + " the house and the river" * 50, None, "s"), (101, "x" * 1_100_000, None, "s")])))
    assert all(rows[d].lang_pred in ("en", "fr") and 0 <= rows[d].score <= 1 for d in (100, 101))


def test_substrings(spark, docs_of, long_words):
    r = random.Random(5)
    half, fresh = long_words[: WORDS // 2], [f"n{r.randrange(10**9)}" for _ in range(WORDS // 2)]
    rows = by_id(cut_repeats(docs_of([(1, " ".join(long_words)), (2, " ".join(fresh + half))])))
    assert rows[1].spans == [] and rows[1].n_words == WORDS
    assert [(s.start, s.stop) for s in rows[2].spans] == [(len(fresh), len(fresh) + len(half))] and rows[2].kept == " ".join(fresh)


def test_quality(spark, docs_of, long_words):
    docs = docs_of([(i, " ".join(long_words[i * 100 : i * 100 + 100])) for i in range(200)] + [(1000, " ".join(long_words)), (1001, "#!" * 600_000)])
    rows = by_id(classify(docs, spark.createDataFrame([(i, 1) for i in range(200)], "doc_id bigint, quality int")))
    assert rows[1000].n_chars == len(" ".join(long_words)) and rows[1000].perplexity < rows[1001].perplexity and not rows[1001].keep


def test_secrets(spark, docs_of, long_words):
    text = " ".join(long_words) + " é password=hunter2xyz"
    row = by_id(scan_secrets(docs_of([(1, text), (2, "plain words")])))[1]
    assert [(s.kind, s.start, s.end) for s in row.base] == [("assign", len(text) - len("password=hunter2xyz"), len(text))]


def test_licenses(spark, docs_of, long_words):
    row = by_id(scan_licenses(docs_of([(1, " ".join(long_words) + " MIT License")])))[1]
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (WORDS + 2, 1, WORDS, WORDS)


def test_jaccard(spark, docs_of, long_words):
    near = [*long_words[: WORDS // 2], "changed", *long_words[WORDS // 2 + 1 :]]
    rows = by_id(jaccard_components(docs_of([(3, " ".join(long_words)), (2, " ".join(near)), (1, " ".join(long_words[: WORDS // 2]))])))
    assert [rows[d].component_id for d in (1, 2, 3)] == [1, 2, 2]


def test_long_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 40)
    x = np.random.default_rng(1).normal(size=(120, 2_500)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, 3).collect()}
    whole = np.floor(256 * x).astype(np.int64)
    for q in (0, 50, 100):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:3]
        assert [got[q, n] for n in (1, 2, 3)] == [(i, -s) for s, i in best]
