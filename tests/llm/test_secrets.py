import re

from lanewise.llm.secret_scan import CharNet, base_spans, candidates, listed, scan_secrets

ODD = [
    "password = 'abc123'", "PassWd:\"x1y2z3\"", "api_key=  short", "apikey: longenough", "token=abcdef secret=ghijkl", "AKIA" + "A" * 16, "AKIAB", "xAKIA" + "Z9" * 10, "0" * 23, "0" * 24, "g" + "deadbeef" * 4 + "g",
    "é password=ünder password=abcdefg", "token = \"" + "0f" * 20 + "\"", "secret : = nothing", "paſsword=abcdefg", "toKen=abcdefg", "password=password=abcdefgh", "",
]


def plain(text):
    """The contract's patterns, written out."""
    out = []
    for kind, pattern, flags, ok in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return out


def test_base_spans_of_every_text(spark, docs_of):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, " ".join(ODD)), (None, ODD[0]), (102, "ä " * 2000 + ODD[0])]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in scan_secrets(docs_of(docs, clashing=True)).collect()}
    order = {"assign": 0, "access": 1, "hex": 2}
    for d, t in docs:
        assert got[d] == sorted(plain(t or ""), key=lambda s: (s[1], order[s[0]])), t


def test_listing(spark, docs_of):
    row = scan_secrets(docs_of([(1, ODD[12])]))
    assert row.select(listed(row["base"]).alias("s")).first().s == "assign:0:49,hex:9:49"


def test_empty_table(spark, docs_of):
    assert scan_secrets(docs_of([])).collect() == []


def test_candidates_hold_context():
    text = "the value is A1" + "b2" * 10 + " here"
    (start, end, window, label), = candidates(text, base_spans(text))
    assert text[start:end] in window and label == 0 and "value is" in window


def test_network_learns_and_adds(spark, docs_of):
    import random

    r = random.Random(1)
    token = lambda: "".join(r.choice("0123456789abcdef") for _ in range(20))
    docs = [(i, f"word and password={token()} then") for i in range(80)]
    docs += [(100 + i, f"mail {'x' * r.randint(3, 9)}{i}-newsletter-archive-page-{r.randint(1, 9)}x again") for i in range(80)]
    docs += [(1000, f"word and passcode={token()} then")]
    rows = {r.doc_id: r for r in scan_secrets(docs_of(docs)).collect()}
    assert all(len(rows[i].base) == 1 for i in range(80))
    assert sum(len(rows[100 + i].added) for i in range(80)) <= 8
    assert len(rows[1000].added) == 1


def test_gradient_step_lowers_the_loss():
    import numpy as np

    net = CharNet()
    windows = ["a" * 84, "9" * 84] * 20
    y = np.array([0.0, 1.0] * 20)
    net.fit(windows, y, steps=60)
    assert net.probability(["9" * 84])[0] > 0.8 > 0.2 > net.probability(["a" * 84])[0]


def test_every_run_of_six_is_a_candidate():
    text = "pwd=x9 passcode: abcxyz é parted.by.dots " + "Q" * 130 + " password: hunter22"
    found = candidates(text, base_spans(text))
    runs = {text[s:e]: y for s, e, _, y in found}
    assert runs == {"pwd=x9": 0, "passcode": 0, "abcxyz": 0, "parted.by.dots": 0, "Q" * 130: 0, "password": 2, "hunter22": 1}
    assert sum(text[s:e][0] == "Q" for s, e, *_ in found) == 5 and all(len(w) == 84 for _, _, w, _ in found)


def test_scores_are_those_of_windows():
    import numpy as np

    from lanewise.llm.secret_scan import _found

    buf = np.frombuffer(("é some words " + "aB3" * 40 + " and further ones").encode(), np.uint8)
    f, net = _found(buf, np.array([0, 20, len(buf)])), CharNet()
    rows = np.arange(len(f.of))
    assert np.allclose(net.scores(f, rows).sum(axis=0), net.logits([f.window(i) for i in rows]), atol=1e-4)


def test_threshold_of_all_findings(spark, docs_of, monkeypatch):
    """Calibration counts every candidate, however few are fitted to."""
    import random

    seen, r = [], random.Random(2)
    keep = CharNet.calibrate
    monkeypatch.setattr(CharNet, "calibrate", lambda self, at, secrets, others, *more: (seen.append((secrets.sum(), others.sum())), keep(self, at, secrets, others, *more))[1])
    token = lambda: "".join(r.choice("0123456789abcdef") for _ in range(20))
    docs = [(i, f"plainly {i} password={token()} further") for i in range(60)]
    scan_secrets(docs_of(docs), findings=20).collect()
    assert sum(s for s, _ in seen) == 60 and sum(o for _, o in seen) == 180


def test_base_spans_need_no_network(spark, docs_of, monkeypatch):
    """Of the same texts, those of the whole scan and those without the network, which then never runs."""
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, " ".join(ODD)), (None, ODD[0])] + [(200 + i, f"some plain words and password=abc{i}def0 here") for i in range(20)]
    whole = sorted((str(r.doc_id), str(r.base)) for r in scan_secrets(docs_of(docs)).collect())
    monkeypatch.setattr("lanewise.llm.secret_scan.train_both", None)
    plain_scan = scan_secrets(docs_of(docs), network=False).collect()
    assert sorted((str(r.doc_id), str(r.base)) for r in plain_scan) == whole
    assert all(r.added == [] and r.score == (1.0 if r.base else 0.0) for r in plain_scan)


def test_scores_of_texts_beyond_a_block():
    """Places are convolved in blocks; windows at the seams score like all others."""
    import numpy as np

    from lanewise.llm.secret_scan import _found

    texts = [" ".join(f"wörd{i % 97}x{'y' * (i % 60)}" for i in range(700)).encode(), b"", b"password=abc\0defgh", b"a" * 24 + b"0" * 24]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    f, net = _found(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])])), CharNet()
    rows = np.arange(len(f.of))
    assert len(f.x) > 3 * net.PLACES and f.base[2] == [] and f.base[3] == [("hex", 0, 48)]
    assert np.allclose(net.scores(f, rows).sum(axis=0), net.logits([f.window(i) for i in rows]), atol=1e-4)
