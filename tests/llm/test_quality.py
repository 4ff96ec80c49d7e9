import math
import random
from collections import Counter

import pytest

from lanewise.llm.quality import ORDER, PAD, classify, discounts, probabilities


def brute_model(texts):
    """Interpolated modified Kneser-Ney, by dictionaries."""
    counts = {ORDER: Counter()}
    for t in texts:
        p = PAD * (ORDER - 1) + t
        counts[ORDER].update(p[i : i + ORDER] for i in range(len(t)))
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    letters = len(counts[1]) + 1

    def discount(n):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            return 0.5, 0.75, 0.9
        y = n1 / (n1 + 2 * n2)
        return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))

    d = {n: discount(n) for n in counts}
    context = {}
    for n in counts:
        for g, c in counts[n].items():
            total, freed = context.get((n, g[:-1]), (0, 0.0))
            context[n, g[:-1]] = total + c, freed + d[n][min(c, 3) - 1]

    def p(g):
        n = len(g)
        if not n:
            return 1 / letters
        if (n, g[:-1]) not in context:
            return p(g[1:])
        total, freed = context[n, g[:-1]]
        c = counts[n][g]
        return (c - (d[n][min(c, 3) - 1] if c else 0) + freed * p(g[1:])) / total

    return p


def test_probabilities_against_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("aab cé") for _ in range(r.randint(0, 60))) for _ in range(30)]
    p = brute_model(texts)
    grams = Counter()
    for t in texts:
        full = PAD * 3 + t
        grams.update(full[i : i + ORDER] for i in range(len(t)))
    wanted = [*grams, "zzzz", "aabz", "cccc", "é é "]
    got = probabilities(spark.createDataFrame(list(grams.items()), "gram string, n bigint"), spark.createDataFrame([(g,) for g in wanted], "gram string"))
    rows = {x.gram: x.p for x in got.collect()}
    assert set(rows) == set(wanted)
    for g in wanted:
        assert rows[g] == pytest.approx(p(g), rel=1e-9), g
    assert discounts(spark.createDataFrame([("a", 1)], "gram string, n bigint"), "n") == (0.5, 0.75, 0.9)


def test_probabilities_sum_to_one(spark):
    counts = Counter()
    for t in ["abab abba", "baab", "aaaa b"]:
        full = PAD * 3 + t
        counts.update(full[i : i + 4] for i in range(len(t)))
    letters = sorted({g[-1] for g in counts})
    wanted = ["aba" + x for x in [*letters, "?"]]
    got = probabilities(spark.createDataFrame(list(counts.items()), "gram string, n bigint"), spark.createDataFrame([(g,) for g in wanted], "gram string"))
    assert sum(x.p for x in got.collect()) == pytest.approx(1.0)


@pytest.fixture(scope="module")
def sample():
    r = random.Random(6)
    vocabulary = {"en": ["the", "house", "green", "walks", "over", "river"], "fr": ["la", "maison", "verte", "marche", "sur", "rivière"]}
    docs, labels = [], []
    for i in range(400):
        lang = r.choice(["en", "fr"])
        text = " ".join(r.choice(vocabulary[lang]) for _ in range(r.randint(20, 60)))
        if i % 10 == 9:
            text = "".join(r.choice("xqz#!%&") for _ in range(200))
        docs.append((i, text, lang, "s"))
        if i % 2:
            labels.append((i, 0 if i % 10 == 9 else 1))
    return docs, labels


def test_junk_goes_and_clean_stays(spark, docs_of, sample):
    docs, labels = sample
    out = classify(docs_of(docs, clashing=True), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert len(out) == len(docs)
    kept = {r.doc_id: r.keep for r in out}
    assert not any(kept[i] for i in range(9, 400, 10))
    assert sum(kept[i] for i in range(400) if i % 10 != 9) / 360 > 0.95


def test_perplexity_of_each_document(spark, docs_of, sample):
    docs, labels = sample
    rows = {r.doc_id: r for r in classify(docs_of(docs), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    held = {r.doc for r in spark.range(1).selectExpr("explode(sequence(0L, 399L)) AS doc").filter("pmod(xxhash64(doc, 'held back'), 5) = 0").collect()}
    p = brute_model([docs[i][1] for i, q in labels if q == 1 and i not in held])
    for i in (0, 3, 9):
        full = PAD * 3 + docs[i][1]
        cost = -sum(math.log(p(full[j : j + 4])) for j in range(len(docs[i][1])))
        assert rows[i].perplexity == pytest.approx(math.exp(cost / len(docs[i][1])), rel=1e-6)


def test_limit_is_the_quantile_of_each_language(spark, docs_of, sample):
    """A text is kept exactly up to the quantile of held-back trusted texts of its language."""
    docs, labels = sample
    lang = {d: x for d, _, x, _ in docs}
    rows = {r.doc_id: r for r in classify(docs_of(docs), spark.createDataFrame(labels, "doc_id bigint, quality int"), quantile=0.9).collect()}
    held = {r.doc for r in spark.range(1).selectExpr("explode(sequence(0L, 399L)) AS doc").filter("pmod(xxhash64(doc, 'held back'), 5) = 0").collect()}
    for x in ("en", "fr"):
        known = sorted(rows[d].score for d, q in labels if q == 1 and d in held and lang[d] == x)
        limit = known[math.ceil(0.9 * len(known)) - 1] if len(known) >= 20 else sorted(rows[d].score for d, q in labels if q == 1 and d in held)[math.ceil(0.9 * sum(q == 1 and d in held for d, q in labels)) - 1]
        for d in rows:
            if lang[d] == x:
                assert rows[d].limit == limit and rows[d].keep == (rows[d].score <= limit) and rows[d].score == pytest.approx(math.log(rows[d].perplexity))


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert classify(docs_of([]), none).collect() == []
    rows = {r.doc_id: r for r in classify(docs_of([(1, "abc"), (2, None), (3, ""), (None, "x", None, None)]), none).collect()}
    assert rows[1].keep and rows[None].keep and not rows[2].keep and not rows[3].keep and rows[2].perplexity is None
