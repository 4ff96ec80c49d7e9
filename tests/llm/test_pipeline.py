import os
import random

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted junk, copies, repeated lines and leaks."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(6)]
    docs = [(i, say(r.randint(40, 90)) + ".\n" + say(30), "en", r.choice("ab"), 0) for i in range(240)]
    docs += [(300 + i, "#!%" * 60 + str(i), "en", "a", 0) for i in range(10)]
    docs += [(400 + i, docs[i][1], "en", "b", 0) for i in range(10)]
    docs += [(500 + i, items[i % 6][1] + " " + say(20) + " " + items[(i + 1) % 6][1], "en", "a", 0) for i in range(10)]
    docs += [(600 + i, say(50) + "\nThe same line at the foot of every page", "en", "a", 0) for i in range(10)]
    docs += [(700, None, None, None, None), (701, "", "en", "a", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 240, 2)] + [(300 + i, 0, 0) for i in range(5)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(240))
    assert len(clean & set(seen["quality"])) >= 0.9 * 240 and not {300 + i for i in range(10)} & set(seen["quality"]) and 700 not in seen["quality"]
    foot = [d for d in range(600, 610) if d in seen["lines"] and "same line" in seen["lines"][d].text]
    assert len(foot) <= 1
    assert not {400 + i for i in range(10)} & set(seen["near_duplicates"])
    assert not {500 + i for i in range(10)} & set(seen["clean_of_benchmark"])
    assert {500 + i for i in range(10)} & set(seen["near_duplicates"])
    last = seen["mix"]
    total = sum(r.size for r in seen["mix"].values())
    assert all(0 < r.taken <= 2 * r.size for r in last.values()) and total > 0
    assert sum(r.taken for r in last.values()) == pytest.approx(1.5 * sum(len((r.text or "").split()) for r in seen["clean_of_benchmark"].values()), abs=3)
    again = {r.doc_id: r.taken for r in P.run(spark, folder).collect()}
    assert again == {d: r.taken for d, r in last.items()}


def test_one_benchmark_item_is_enough(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item, half = say(30), say(20)
    docs = [(1, say(40)), (2, f"{say(9)} {item} {say(9)}"), (3, f"{say(9)} {' '.join(half.split()[4:14])} {say(9)}"), (4, None), (5, " ".join(item.split()[:7]))]
    spark.createDataFrame([(1, item), (2, half)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.clean_of_benchmark(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5]


def test_near_duplicates_by_five_words(spark):
    """A copy with 15 hundredths appended links by 5-word shingles at 0.8, not by 3 words at 0.9."""
    import corpus_pipeline as P

    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    text = say(100)
    docs = [(1, text), (2, f"{text} {say(15)}"), (3, f"{text} {say(40)}"), (4, say(100))]
    out = P.near_duplicates(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def say(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_near_duplicates_without_ids(spark):
    """Rows without id, and texts that share one, stand and fall by their own text."""
    import corpus_pipeline as P

    r = random.Random(7)
    first, other, third, fourth = (say(r, 60) for _ in range(4))
    near = lambda t: t + " changed"
    docs = [(1, first), (None, first), (None, other), (None, near(other)), (None, None), (5, third), (5, near(first)), (5, fourth), (6, near(third)), (7, None), (7, ""), (9, fourth), (9, fourth)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' number", "'y' copy", "'z' r_id")
    out = P.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    left = [(x.doc_id, x.text) for x in out.collect()]
    assert (1, first) in left and (None, first) not in left and (5, near(first)) not in left
    assert len({(None, other), (None, near(other))} & set(left)) == 1
    assert len({(5, third), (6, near(third))} & set(left)) == 1
    assert len([x for x in left if x[1] == fourth]) in (1, 2) and ((5, fourth) in left) != ((9, fourth) in left)
    assert {(None, None), (7, None), (7, "")} <= set(left)


def test_mix_of_repeated_rows(spark):
    import corpus_pipeline as P

    df = spark.createDataFrame([(1, "a b", "s", {"k": 1})] * 4 + [(None, " ", "s", None)], "doc_id bigint, text string, source string, m map<string,int>").selectExpr("*", "'x' taken", "'y' rest", "'z' rank")
    out = P.mix(spark, df, "")
    assert sorted(r.taken for r in out.collect()) == [2, 2, 4, 4] and {(r.rest, r.rank, r.text) for r in out.collect()} == {("y", "z", "a b")}


def test_stages_on_odd_tables(spark, folder):
    """Null ids, texts, languages and sources, repeated rows, clashing names, and empty tables."""
    import corpus_pipeline as P

    r = random.Random(3)
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, say(r, 40), "en", "a", 0), (1, say(r, 40), None, None, 1), (None, say(r, 40), "en", "a", None), (None, None, None, None, None), (2, "", "en", "b", 0)]
    rows += [rows[0], rows[2], (3, say(r, 30) + "\n" + say(r, 160_000), "en", "b", 2)]
    clashes = ["'k' key", "'t' text_key", "'n' number", "1 taken_", "'l' line", "'d' doc", "'g' g", "'s' size", "'r' r_id", "'e' rest", "'a' alike"]
    docs = spark.createDataFrame(rows, kind).selectExpr("*", *clashes)
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        assert name == "mix" or out.columns == docs.columns
        found = [x.text for x in out.collect()]
        assert rows[-1][1] in found and all(t in (x[1] for x in rows) for t in found), name
        assert stage(spark, docs.limit(0), folder).collect() == [], name


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_queries_against_sql(spark):
    """The queries that have SQL, on the smallest tables."""
    import duckdb

    from lanewise.llm import catalog

    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    for name, sql in catalog.ORACLES.items():
        got, want = catalog.QUERIES[name](spark, FOLDER), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
        assert rows == sorted(tuple(str(r[want.columns.index(c)]) for c in sorted(got.columns)) for r in want.fetchall()), name


def test_run_against_brute_force(spark, tmp_path):
    """The whole pipeline against plain versions of its stages, one after the other."""
    import math

    import corpus_pipeline as P
    from test_decontamination import words as plain_words
    from test_lines import brute as plain_lines
    from test_mixing import queue, size
    from test_quality import ORDER, PAD, brute_model

    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(150)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item, foot = some(12), some(9)
    docs = []
    for i in range(150):
        text = some(r.randint(15, 50))
        if i % 12 == 5 and docs:
            text = r.choice([t for d, t, *_ in docs if d % 19 != 2]) + (" end" if i % 24 == 5 else "")
        if i % 15 == 4:
            text += "\n" + foot
        if i % 17 == 3:
            text += " " + item
        if i % 19 == 2:
            text = "".join(r.choice("#!%&xqz") for _ in range(150))
        docs.append((i, text, "en", r.choice(["a", "b", "c"])))
    labels = [(d, 1) for d, t, *_ in docs if d % 3 and d % 19 != 2]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    held = {x.doc for x in spark.range(1).selectExpr("explode(sequence(0L, 149L)) AS doc").filter("pmod(xxhash64(doc, 'held back'), 5) = 0").collect()}
    p = brute_model([docs[d][1] for d, _ in labels if d not in held])
    score = {d: -sum(math.log(p((PAD * (ORDER - 1) + t)[j : j + ORDER])) for j in range(len(t))) / len(t) for d, t, *_ in docs}
    known = sorted(score[d] for d, _ in labels if d in held)
    assert len(known) >= 20
    limit = known[math.ceil(0.99 * len(known)) - 1]
    left = [x for x in docs if score[x[0]] <= limit + 1e-9]
    assert 100 < len(left) < 150

    lines = {d: (t, gone) for d, t, _, gone in plain_lines(left)}
    left = [(d, lines[d][0], *rest) for d, _, *rest in left if not lines[d][1] or lines[d][0].strip()]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    root = {d: d for d, *_ in left}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {d: grams(t) for d, t, *_ in left}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    left = [x for x in left if top(x[0]) == x[0]]

    def windows(w):
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    left = [x for x in left if not windows(plain_words(x[1])) & windows(plain_words(item))]
    budget = 3 * sum(size(t) for _, t, *_ in left) // 2
    want = {d: n for d, n in queue(left, budget, max(1, budget // 100_000)).items() if n}
    got = {x.doc_id: (x.text, x.taken) for x in P.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(d for d, *_ in left if d in want)
    assert got == {d: (t, want[d]) for d, t, *_ in left if d in want}
