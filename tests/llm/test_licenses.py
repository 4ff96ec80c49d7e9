import re

from lanewise.llm.license_scan import NOTICES, PHRASES, scan_licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(t):
    w, places, labels = words(t), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_base_against_brute_force(spark, docs_of, corpus):
    docs = [*corpus, (5001, "The MIT License and the mit-license; Apache License MIT License"), (5002, "general public general public license"), (5003, "mit"), (5004, "license. mit\n\nLicense"), (None, "MIT license")]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, sorted(r.named)) for r in scan_licenses(docs_of(docs, clashing=True)).collect()), key=str)
    assert got == sorted(((d, *base(t)) for d, t, *_ in docs), key=str)


def test_notices_are_found(spark, docs_of):
    docs = [(i, f"some words before {text} and some after") for i, (_, text) in enumerate(NOTICES)]
    mit = NOTICES[1][1].split()
    docs += [(100, " ".join(mit[:40] + ["inserted"] + mit[40:])), (101, " ".join(mit[:9])), (102, "nothing of the kind"), (103, None)]
    rows = {r.doc_id: r for r in scan_licenses(docs_of(docs)).collect()}
    for i, (label, _) in enumerate(NOTICES):
        assert label in rows[i].noticed, label
    assert rows[100].noticed == ["mit"] and rows[100].score > 0.9 and len([s for s in rows[100].spans if s.share > 0.9]) == 1
    assert rows[101].noticed == [] and rows[102].noticed == [] and rows[103].score == 0
    at = rows[1].spans[0]
    assert (at.start, at.matched) == (3, len(words(NOTICES[1][1])))


def test_empty_table_and_copies(spark, docs_of):
    assert scan_licenses(docs_of([])).collect() == []
    text = NOTICES[2][1]
    rows = scan_licenses(docs_of([(1, text), (1, text), (2, text)])).collect()
    assert len(rows) == 3 and all(r.noticed == ["apache"] for r in rows)


def test_voting_against_brute_force(spark, docs_of):
    """Notices with words left out, changed and added, against a longest-run comparison of whole texts."""
    import random
    from difflib import SequenceMatcher

    r, docs = random.Random(4), []
    for i in range(60):
        label, text = NOTICES[i % len(NOTICES)]
        w = words(text)
        for _ in range(r.choice([0, 0, 1, 3, len(w) // 4])):
            at = r.randrange(len(w))
            w[at : at + r.choice([0, 1, 1])] = r.choice([[], ["other"], ["two", "more"]])
        if i % 7 == 0:
            w = w[: len(w) // r.choice([2, 3, 5])]
        docs.append((i, " ".join(["lead"] * r.randint(0, 9) + w + ["tail"] * r.randint(0, 9))))
    rows = {x.doc_id: x for x in scan_licenses(docs_of(docs)).collect()}
    for d, text in docs:
        w, want, sure = words(text), set(), set()
        for label, notice in NOTICES:
            n = words(notice)
            matched = sum(m.size for m in SequenceMatcher(None, w, n, autojunk=False).get_matching_blocks() if m.size >= 3)
            if matched >= 0.8 * len(n) or matched >= 24 and matched >= 0.35 * len(n):
                want.add(label)
            if matched >= 0.8 * len(n):
                sure.add(label)
        assert sure <= set(rows[d].noticed) <= want, (d, text)
        assert all(s.share <= 1 and 0 <= s.start < s.stop <= len(w) for s in rows[d].spans)
