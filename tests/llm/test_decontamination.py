import hashlib
import re

from lanewise.llm.decontamination import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(8, len(w))
        for p in range(len(w) - n + 1):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for d, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((d, len(w), len(hit), sorted(map(str, found)), len(found) >= 2))
    return sorted(out, key=str)


def got(spark, docs_of, docs, items, **kw):
    df = decontaminate(docs_of(docs, **kw), spark.createDataFrame(items, "item_id bigint, text string"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=str)


def test_against_brute_force(spark, docs_of, corpus):
    texts = [t for _, t, *_ in corpus if t]
    items = [(1, " ".join(texts[0].split()[:40])), (2, texts[3]), (3, "one"), (4, "one two"), (5, ""), (6, None), (None, texts[8]), (10, texts[9].upper()), (11, "a b c"), (12, " ".join(texts[3].split()[5:25]))]
    assert got(spark, docs_of, corpus, items, clashing=True) == brute(corpus, items)


def test_window_edges(spark, docs_of):
    item = "a b c d e f g h i"
    docs = [(1, item), (2, "a b c d e f g"), (3, "b c d e f g h i"), (4, "z a b c d e f g h"), (5, "A, b. C d\ne f g H"), (6, "a b c d e f g x h i"), (7, "h g f e d c b a")]
    result = {r[0]: r[2] for r in got(spark, docs_of, docs, [(1, item)])}
    assert result == {1: 9, 2: 0, 3: 8, 4: 8, 5: 8, 6: 0, 7: 0}


def test_empty_tables(spark, docs_of):
    assert got(spark, docs_of, [], [(1, "a b")]) == []
    assert got(spark, docs_of, [(1, "a b")], []) == [(1, 2, 0, [], False)]


def test_repeated_and_null_rows(spark, docs_of):
    docs = [(1, "q w e"), (1, "q w e"), (None, "q w e"), (2, None)]
    assert got(spark, docs_of, docs, [(7, "w e"), (8, "q w")]) == sorted([(1, 3, 3, ["7", "8"], True)] * 2 + [(None, 3, 3, ["7", "8"], True), (2, 0, 0, [], False)], key=str)


def test_digest_of_ids():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
