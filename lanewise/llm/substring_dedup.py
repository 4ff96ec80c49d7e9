"""Substring dedup over a compacted De Bruijn graph of word k-mers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import _memory as M
from lanewise.llm import _buckets as B
from lanewise.llm import _words as W

#: Bytes of text in a group of documents, and of path or edge records in a bucket, on average.
GROUP_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20

PATH = np.dtype([("anchor", "<u8"), ("path", "<u8"), ("doc", "<i8"), ("group", "<u4")])
EDGE = np.dtype([("edge", "<u8"), ("check", "<u4"), ("group", "<u4"), ("doc", "<i8")])
ANSWER = np.dtype([("key", "<u8"), ("key2", "<u8"), ("kind", "u1")])
#: Kinds of answers to a group: an earlier document has the path; the path's anchor branches; an earlier document has the edge.
EARLIER, BRANCH, EDGE_EARLIER = 1, 2, 3

_RADIX = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))


@dataclass(frozen=True)
class Shape:
    """Words of an edge (a k-mer), and of the gram that anchors a path of edges."""

    k: int = 13
    anchor: int = 6


@dataclass
class Paths:
    """The paths of a block: maximal runs of edges with one anchor, in order."""

    text: np.ndarray  # of each path
    first: np.ndarray  # its first edge (the word that it starts with)
    count: np.ndarray  # of its edges
    anchor: np.ndarray
    path: np.ndarray  # hash of all its words; with the anchor's, 128 bits tell paths apart


def paths_of(block: W.Block, shape: Shape) -> Paths:
    """Each edge's anchor is its least gram (the last, in ties), which its words alone decide. So
    texts that share words cut them into the same paths, but for the ends."""
    grams = W.gram_hashes(block.hashes, shape.anchor)
    width = shape.k - shape.anchor + 1
    n = len(block.hashes) - shape.k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Paths(none, none, none, none.view(np.uint64), none.view(np.uint64))
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        less = grams[j : j + n] <= best
        best[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    inside = np.flatnonzero(W.gram_starts(block.word_at, shape.k))
    at, best = at[inside], best[inside]
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(inside)))
    first = inside[start]
    size = len(block.hashes)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, r, np.uint64)])) for r in (_RADIX, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(block.hashes * up[:size])])
    words = count + shape.k - 1
    path = W.mix64((sums[first + words] - sums[first]) * down[first] + words.astype(np.uint64))
    return Paths(block.text_of_word()[first], first, count, best[start], path)


class Group:
    """The paths of a group of documents, and which of them an earlier document of the group has."""

    def __init__(self, table: pa.Table, shape: Shape):
        self.table = table.combine_chunks()
        self.shape = shape
        self.docs = self.table["doc_id"].to_numpy()
        self.known = self.table["known"].to_numpy()
        self.group = np.uint32(self.table["g"][0].as_py()) if len(self.table) else np.uint32(0)
        column = self.table["text"]
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        self.blocks = list(W.blocks(column, W.SPACED))
        self.paths = [paths_of(b, shape) for b in self.blocks]
        none = [np.zeros(0, np.uint64)]
        self.key, self.key2 = (np.concatenate(x or none) for x in ([p.anchor for p in self.paths], [p.path for p in self.paths]))
        self.row = np.concatenate([b.first + p.text for b, p in zip(self.blocks, self.paths)] or [np.zeros(0, np.int64)])
        self.doc, self.named = self.docs[self.row], self.known[self.row]
        self.least = least(self.key, self.key2, self.doc, self.named)

    def split(self, flags: np.ndarray) -> list[np.ndarray]:
        return np.split(flags, np.cumsum([len(p.first) for p in self.paths])[:-1]) if self.paths else []

    def answered(self, answers: np.ndarray, kind: int) -> np.ndarray:
        """Which paths have an answer of this kind."""
        some = answers[answers["kind"] == kind]
        return among(self.key, self.key2, some["key"], some["key2"])

    def edges(self, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, path's place in the group, word, hash, another of 32 bits) of all edges of the chosen paths."""
        done = 0
        for i, (block, paths) in enumerate(zip(self.blocks, self.paths)):
            mine = np.flatnonzero(chosen[done : done + len(paths.first)])
            word = B.spans_of(paths.first[mine], paths.count[mine])
            first, second = (W.gram_hashes(block.hashes, self.shape.k, seed)[word] if len(word) else word.view(np.uint64) for seed in (0, 1))
            yield i, done + np.repeat(mine, paths.count[mine]), word, first, second >> np.uint64(32)
            done += len(paths.first)


def numbered(key: np.ndarray, key2: np.ndarray) -> np.ndarray:
    """A number for each record, the same for equal pairs of keys."""
    order = np.lexsort((key2, key))
    a, b = key[order], key2[order]
    fresh = np.ones(len(a), np.int64)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


def among(key: np.ndarray, key2: np.ndarray, some: np.ndarray, some2: np.ndarray) -> np.ndarray:
    """Which pairs of keys are among some others."""
    maybe = np.flatnonzero(np.isin(key, some))
    out = np.zeros(len(key), bool)
    if len(maybe):
        index = numbered(np.concatenate([key[maybe], some]), np.concatenate([key2[maybe], some2]))
        out[maybe] = np.isin(index[: len(maybe)], index[len(maybe) :])
    return out


def least(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, named: np.ndarray) -> np.ndarray:
    """For each record the least doc of the named records with its keys."""
    if not len(key):
        return doc
    index = numbered(key, key2)
    lowest = np.full(index.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, index[named], doc[named])
    return lowest[index]


def _emit_paths(shape: Shape, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        group = Group(table, shape)
        mine = np.flatnonzero(group.named)
        _, first = np.unique(numbered(group.key[mine], group.key2[mine]), return_index=True)
        mine = mine[first]
        records = np.zeros(len(mine), PATH)
        records["anchor"], records["path"], records["doc"], records["group"] = group.key[mine], group.key2[mine], group.least[mine], group.group
        return pa.Table.from_batches([B.packed((W.mix64(records["anchor"]) % np.uint64(buckets)).astype(np.int64), records)])

    return run


def _answers(groups: np.ndarray, key: np.ndarray, key2: np.ndarray, kind: np.ndarray) -> pa.Table:
    out = np.zeros(len(key), ANSWER)
    out["key"], out["key2"], out["kind"] = key, key2, kind
    return pa.Table.from_batches([B.packed(groups.astype(np.int64), out)])


def _resolve_paths(table: pa.Table) -> pa.Table:
    r = np.sort(B.unpacked(table["part"], PATH), order=["anchor", "path", "doc"])
    if not len(r):
        return _answers(r["group"], r["anchor"], r["path"], r["group"])
    new_anchor = np.concatenate([[True], r["anchor"][1:] != r["anchor"][:-1]])
    new_path = new_anchor | np.concatenate([[True], r["path"][1:] != r["path"][:-1]])
    least_doc = r["doc"][np.flatnonzero(new_path)][np.cumsum(new_path) - 1]
    anchor_no = np.cumsum(new_anchor) - 1
    branches = (np.bincount(anchor_no, weights=new_path) > 1)[anchor_no]
    later, branching = r["doc"] > least_doc, branches & (r["doc"] == least_doc)
    both = lambda c: np.concatenate([r[c][later], r[c][branching]])
    return _answers(both("group"), both("anchor"), both("path"), np.concatenate([np.full(later.sum(), EARLIER), np.full(branching.sum(), BRANCH)]))


def _emit_edges(shape: Shape, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(docs, shape)
        a = B.unpacked(answers["part"], ANSWER)
        chosen = group.answered(a, BRANCH) & group.named & (group.doc == group.least)
        parts = []
        for _, path, word, edge, check in group.edges(chosen):
            e = np.zeros(len(word), EDGE)
            e["edge"], e["check"], e["doc"], e["group"] = edge, check, group.doc[path], group.group
            parts.append(e)
        e = np.concatenate(parts or [np.zeros(0, EDGE)])
        e = e[np.lexsort((e["doc"], e["check"], e["edge"]))]
        if len(e):
            e = e[np.concatenate([[True], (e["edge"][1:] != e["edge"][:-1]) | (e["check"][1:] != e["check"][:-1])])]
        return pa.Table.from_batches([B.packed((e["edge"] % np.uint64(buckets)).astype(np.int64), e)])

    return run


def _resolve_edges(table: pa.Table) -> pa.Table:
    e = np.sort(B.unpacked(table["part"], EDGE), order=["edge", "check", "doc"])
    fresh = np.ones(len(e), bool)
    fresh[1:] = (e["edge"][1:] != e["edge"][:-1]) | (e["check"][1:] != e["check"][:-1])
    later = e["doc"] > e["doc"][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(e) else fresh
    return _answers(e["group"][later], e["edge"][later], e["check"][later], np.full(later.sum(), EDGE_EARLIER))


def _cut_out(shape: Shape, kind: pa.DataType):
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(docs, shape)
        a = B.unpacked(answers["part"], ANSWER)
        whole = group.named & (group.answered(a, EARLIER) | (group.doc > group.least))
        open_ = group.named & ~whole & group.answered(a, BRANCH)
        places = list(group.edges(open_))
        edge, check, path = (np.concatenate([p[i] for p in places] or [np.zeros(0, t)]) for i, t in ((3, np.uint64), (4, np.uint64), (1, np.int64)))
        doc, earlier = group.doc[path], a[a["kind"] == EDGE_EARLIER]
        gone = among(edge, check, earlier["key"], earlier["key2"]) | (doc > least(edge, check, doc, np.ones(len(doc), bool)))
        done = 0
        rows = len(group.table)
        words, spans, kept = np.zeros(rows, np.int64), [[] for _ in range(rows)], [""] * rows
        for block, flags, (_, p, word, *_) in zip(group.blocks, group.split(whole), places):
            paths = group.paths[0] if len(group.paths) == 1 else group.paths[next(i for i, b in enumerate(group.blocks) if b is block)]
            change = np.zeros(len(block.hashes) + 1, np.int64)
            taken = np.flatnonzero(flags)
            starts = np.concatenate([paths.first[taken], word[gone[done : done + len(word)]]])
            lengths = np.concatenate([paths.count[taken] + shape.k - 1, np.full(int(gone[done : done + len(word)].sum()), shape.k)])
            done += len(word)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + lengths, -1)
            removed = np.cumsum(change)[:-1] > 0
            words[block.first : block.first + len(block)] = np.diff(block.word_at)
            raw = block.buf.tobytes()
            edge_of = np.flatnonzero(np.diff(np.concatenate([[0], removed.view(np.int8), [0]])))
            begin, stop = edge_of[::2], edge_of[1::2]
            # a run of removed words may pass from one text into the next
            for t in range(len(block)):
                lo, hi = int(block.word_at[t]), int(block.word_at[t + 1])
                i, j = np.searchsorted(stop, lo, side="right"), np.searchsorted(begin, hi)
                spans[block.first + t] = [{"start": max(int(x), lo) - lo, "stop": min(int(y), hi) - lo} for x, y in zip(begin[i:j], stop[i:j])]
                stay = lo + np.flatnonzero(~removed[lo:hi])
                kept[block.first + t] = b" ".join([raw[x:y] for x, y in zip(block.start[stay].tolist(), block.end[stay].tolist())]).decode("utf-8", "replace")
        return pa.table([group.table["id"], pa.array(words), pa.array(spans, pa.list_(span)), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return run


def cut_repeats(docs: DataFrame, k: int = 13, anchor: int = 6, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """For each row of docs: doc_id, n_words, spans (start, stop: the runs of removed words), kept
    (the other words, joined by one space).

    A word goes if some ``k`` consecutive words over it also start in a document of smaller id;
    this is judged on the input. Words are parted by ASCII white space and otherwise unchanged.

    k-mers are the edges of a De Bruijn graph. Edges in a row that share an anchor, the least gram
    inside, are compacted to one path before anything moves. A join by anchor finds for each path
    its earliest document; where an anchor has one path only, the path doesn't branch and is settled
    whole. Where it branches (a shared span ends or differs), the earliest document of each path
    unfolds it to edges, and a second join, by edge, finds their earliest documents. Paths are told
    apart by 128 bits of hashes and edges by 96, in joins, groups and answers alike; words are not
    compared beyond that. The groups' coordinates then make up the spans.

    Documents are dealt to groups by id, and texts move once. A group sends a path or an edge once,
    with the smallest id it has there, so what is found in very many documents weighs as much as
    one record for each group.

    Null, empty or short texts have no edges and lose nothing; null text has no words. Rows that
    share an id are one document. A row without id keeps all its words and marks none. An empty
    table gives an empty result. Other columns are ignored.
    """
    doc_id, text = columns
    shape = Shape(k, anchor)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, int(size / GROUP_BYTES))
    # about a path for every 4.5 words, and 6 bytes a word
    buckets = max(8, int(size / 27 * PATH.itemsize / BUCKET_BYTES))
    kind = docs.schema[doc_id].dataType.simpleString()
    number = F.col(doc_id).cast("long")
    dealt = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(number, F.lit(0)).alias("doc_id"),
        number.isNotNull().alias("known"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.coalesce(number, F.xxhash64(text))), F.lit(groups)).alias("g"),
    )
    by_group = dealt.groupBy("g")
    parts = by_group.applyInArrow(M.group(_emit_paths(shape, buckets)), B.SCHEMA)
    answers = parts.groupBy("bucket").applyInArrow(M.group(_resolve_paths), B.SCHEMA).withColumnRenamed("bucket", "g")
    edges = by_group.cogroup(answers.groupBy("g")).applyInArrow(M.cogroup(_emit_edges(shape, buckets)), B.SCHEMA)
    more = edges.groupBy("bucket").applyInArrow(M.group(_resolve_edges), B.SCHEMA).withColumnRenamed("bucket", "g")
    out = by_group.cogroup(answers.union(more).groupBy("g"))
    return out.applyInArrow(M.cogroup(_cut_out(shape, None)), f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, kept string")
