import hashlib
import re

import pytest

from lanewise.llm import mixing
from lanewise.llm.mixing import mix_sources


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fair(docs):
    """Targets by filling source after source."""
    sizes = {}
    for _, t, _, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] / w >= 2 * sizes[s]} if w else set()
        if not over:
            return sizes, {s: 2.0 * sizes[s] if s in full else left * weight[s] / w for s in order}
        full |= over


def queue(docs, budget, packet, epochs=2):
    """Words taken of each document, packet by packet in the order of finish times."""
    order = sorted({s for *_, s in docs if s is not None}) + ([None] if any(s is None for *_, s in docs) else [])
    packets = []
    for rank, s in enumerate(order):
        mine = sorted((hashlib.md5(str(d).encode()).hexdigest(), d, size(t)) for d, t, _, x in docs if x == s)
        at = 0
        for _ in range(epochs):
            for _, d, n in mine:
                for part in range(0, n, packet):
                    words = min(packet, n - part)
                    at += words
                    packets.append((at / (3, 1, 2)[rank % 3], rank, at, d, words))
    taken = {d: 0 for d, *_ in docs}
    for *_, d, words in sorted(packets):
        taken[d] += min(words, budget)
        budget -= min(words, budget)
    return taken


def test_the_queue_decides(spark, docs_of, corpus, monkeypatch):
    docs = [d for d in corpus if d[0] is not None]
    budget = 3 * sum(size(t) for _, t, *_ in docs) // 2
    for packets in (30, 500):
        monkeypatch.setattr(mixing, "PACKETS", packets)
        got = {r.doc_id: r.taken for r in mix_sources(docs_of(docs)).collect()}
        assert got == queue(docs, budget, max(1, budget // packets))


def test_ranges_are_even(spark, docs_of, monkeypatch):
    """Finish times that crowd together, and a third of the rows without id, are dealt evenly."""
    import pyspark.sql.functions as F

    seen, keep = [], mixing.in_ranges
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 400)
    monkeypatch.setattr(mixing, "in_ranges", lambda df, n, order, name: (seen.append((keep(df, n, order, name), name)), seen[-1][0])[1])
    docs = [(None if i % 3 == 0 else i, " ".join(["w"] * (1 if i % 2 else 40)), "en", "a" if i < 800 else f"s{i % 7}") for i in range(1000)]
    assert mix_sources(docs_of(docs)).count() == 1000
    for df, name in seen:
        sizes = [r["n"] for r in df.groupBy(name).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 2.5 * sum(sizes) / len(sizes), name


def rows(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket", [700, 20_000])
def test_contract(spark, docs_of, corpus, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    df = docs_of(corpus, clashing=True)
    out = mix_sources(df).collect()
    sizes, targets = fair(corpus)
    assert len(out) == len(corpus)
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    packet = max(1, int(1.5 * sum(sizes.values())) // mixing.PACKETS)
    for s, n in taken.items():
        assert abs(n - targets[s]) <= packet * len(sizes)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))


def test_buckets_and_reruns_make_no_difference(spark, docs_of, corpus, monkeypatch):
    df = docs_of(corpus)
    first = rows(mix_sources(df))
    assert first == rows(mix_sources(df.repartition(7)))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 400)
    assert first == rows(mix_sources(df))


def test_odd_tables(spark, docs_of):
    assert rows(mix_sources(docs_of([]))) == []
    assert rows(mix_sources(docs_of([(1, None), (2, " ")]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    same = mix_sources(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(same) == 3 and sum(r.taken for r in same) == 7
    same = mix_sources(docs_of([(1, "a b")] * 4, clashing=True), carry=("target", "rest")).collect()
    assert sorted(r.taken for r in same) == [2, 2, 4, 4] and {tuple(r.rest) for r in same} == {("x", "x")}


def test_runs_no_python(spark, docs_of):
    plan = mix_sources(docs_of([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
