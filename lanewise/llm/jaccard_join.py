"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures."""

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
from lanewise.llm._tables import bit_map, cut
from lanewise.llm.components import components

#: Slots in which shingles are counted; of those found common, so many at most are known by rank.
SLOTS, COMMON = 1 << 20, 60_000
#: Bytes of tile entries that a bucket holds on average, and entries of a tile that are all paired at once.
BUCKET_BYTES, SMALL_TILE = 16 << 20, 16
#: Entries that a part of a common shingle's tile holds on average, and sets of a tile that one task compares with so many others.
PART, BLOCK, BLOCK_SHINGLES = 1 << 18, 4096, 1 << 22
#: Places for each shingle, at least, of the signatures that such a task compares.
WIDE = 2
#: Shingles for each place, at most, of the signatures that sieve pairs of sets before: two unlike sets
#: differ in half of the places, and so in more than sets that link may.
BRIEF = 3
#: Pairs that a task looks at in one step.
STEP = 1 << 18
#: Bits of the map that documents are sieved with before their texts move; a fixed size.
SIEVE_BITS = 1 << 23

ENTRY = np.dtype([("token", "<u8"), ("set", "<u8"), ("n", "<u4"), ("at", "<u4"), ("home", "<u2"), ("parts", "<u2"), ("band", "<u4"), ("bits", "<u8", 2)])


@dataclass(frozen=True)
class Shape:
    """Words of a shingle, and the least similarity in hundredths."""

    gram: int = 3
    percent: int = 90

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Shared shingles without which a set of n links with none."""
        return (self.percent * n + 99) // 100

    def overlap(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Shared shingles that make sets of n and m link."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def band(self, n: np.ndarray) -> np.ndarray:
        """Sets that can link are in the same band or in neighbouring ones."""
        return np.floor(np.log(np.maximum(n, 1)) / -np.log(self.percent / 100 - 1e-9)).astype(np.int64)


def shingle_sets(block: W.Block, gram: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; of one with fewer words, all its words as one."""
    hashes = W.gram_hashes(block.hashes, gram)
    for a, b in zip(block.word_at[:-1].tolist(), block.word_at[1:].tolist()):
        if b - a >= gram:
            found = np.sort(hashes[a : b - gram + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif b > a:
            yield W.gram_hashes(block.hashes[a:b], b - a, seed=b - a)
        else:
            yield hashes[:0]


def set_hash(s: np.ndarray, salt: int) -> int:
    with np.errstate(over="ignore"):
        return int(W.mix64(s ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(s)))


def signature(s: np.ndarray, wide: int = 1) -> bytes:
    """A bit for each place that an odd number of shingles falls on; ``wide`` times as many places as
    shingles at least. Sets differ in at least as many shingles as their signatures do in bits."""
    places = 64 << max(0, (len(s) * wide - 1).bit_length() - 6)
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def brief(bits: bytes, n: int) -> bytes:
    """The signature of a set of n, folded to a place for BRIEF shingles at least."""
    words = 1 << max(0, (-(-n // BRIEF) - 1).bit_length() - 6)
    return np.bitwise_xor.reduce(np.frombuffer(bits, "<u8").reshape(-1, words), axis=0).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """Bits by which two signatures differ, the longer folded to the length of the shorter."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


_SALTS = (0x51ED270B9F4D3C21, 0x1F83D9ABFB41BD6B)


def _slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def _describe(gram: int):
    """A row for each text; after a partition's last, rows of slots that are common in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, slots, names = None, np.zeros(SLOTS, np.int64), ["doc_id", "n", "set", "set2", "bits", "slot", "times"]
        for batch in batches:
            kind = batch.column("doc_id").type
            n, one, two, seen = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), []
            marks: list[bytes | None] = [None] * batch.num_rows
            for block in W.blocks(batch.column("text"), W.SPACED_LOWER):
                for row, s in enumerate(shingle_sets(block, gram), block.first):
                    n[row], one[row], two[row] = len(s), set_hash(s, _SALTS[0]), set_hash(s, _SALTS[1])
                    marks[row] = signature(s) if len(s) else None
                    seen.append(_slot(s))
                if sum(map(len, seen)) > SLOTS:
                    slots += np.bincount(np.concatenate(seen), minlength=SLOTS)
                    seen = []
            if seen:
                slots += np.bincount(np.concatenate(seen), minlength=SLOTS)
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), pa.array(W.signed(one)), pa.array(W.signed(two)), pa.array(marks, pa.binary()), nothing, nothing], names=names)
        mean = slots.mean()
        common = np.flatnonzero(slots > mean + 8 * np.sqrt(mean) + 8)
        if kind is not None and len(common):
            nothing = pa.nulls(len(common), pa.int64())
            yield pa.record_batch([pa.nulls(len(common), kind), nothing, nothing, nothing, pa.nulls(len(common), pa.binary()), pa.array(common), pa.array(slots[common])], names=names)

    return run


def _bits_from(s: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each token of a prefix the parity bits, in 128 places, of the set without the tokens before it."""
    odd = np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 1
    bits = np.zeros((len(prefix), 2), np.uint64)
    place = (prefix[:-1] & np.uint64(127)).astype(np.int64)
    bits[np.arange(1, len(prefix)), place >> 6] = np.uint64(1) << (place & 63).astype(np.uint64)
    bits[0] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
    return np.bitwise_xor.accumulate(bits, axis=0)


def _entries(shape: Shape, ranks: np.ndarray, parts: np.ndarray, buckets: int):
    """Tile entries of the prefix of each set: its rarest shingles, as many as cannot all be missed.
    The tile of a shingle of rank r is dealt over parts[r] parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            out = []
            for block in W.blocks(batch.column("text"), W.SPACED_LOWER):
                for s in shingle_sets(block, shape.gram):
                    name = set_hash(s, _SALTS[0])
                    if not len(s) or name in done:
                        continue
                    done.add(name)
                    n = len(s)
                    rank = ranks[_slot(s)]
                    keep = n - int(shape.needed(n)) + 1
                    if rank.any():
                        first = np.argsort(rank, kind="stable")[:keep]
                        prefix, rank = s[first], rank[first]
                    else:
                        prefix, rank = s[:keep], rank[:keep]
                    e = np.zeros(keep, ENTRY)
                    e["token"], e["set"], e["n"], e["at"] = prefix, name, n, np.arange(keep)
                    e["bits"], e["parts"] = _bits_from(s, prefix), parts[rank]
                    # a common shingle's tile is dealt out by bands; each set also visits the band below
                    e["home"] = 1
                    usual = rank > 0
                    if usual.any():
                        band = int(shape.band(np.array(n))) + 1
                        e["band"][usual] = band
                        visit = e[usual]
                        visit["band"], visit["home"] = band - 1, 0
                        e = np.concatenate([e, visit])
                    out.append(e)
            if out:
                e = np.concatenate(out)
                part = W.mix64(e["set"]) % e["parts"].astype(np.uint64)
                yield B.packed((W.mix64(_tile(e) + part) % np.uint64(buckets)).astype(np.int64), e)

    return run


def _may_link(shape: Shape, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False only where sizes, places or signatures prove that two sets don't link, or that they share
    an earlier token, in whose tile they meet: of the first token that they share, all before it in
    either set are shingles that the other has not, and from it on they differ in as many at least as
    their sizes and signatures from there on do."""
    n, m, i, j = (v.astype(np.int64) for v in (x["n"], y["n"], x["at"], y["at"]))
    most = n + m - 2 * shape.overlap(n, m)
    apart = np.bitwise_count(x["bits"] ^ y["bits"]).sum(axis=-1).astype(np.int64)
    ok = i + j + np.maximum(apart, np.abs((n - i) - (m - j))) <= most
    return ok & (x["set"] != y["set"]) & ((x["home"] | y["home"]) == 1)


def _tile(e: np.ndarray) -> np.ndarray:
    return W.mix64(e["token"] + e["band"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1).view([("a", "<u8"), ("b", "<u8")])) if len(a) else np.zeros(0, [("a", "<u8"), ("b", "<u8")])
    return pa.table([pa.array(both["a"].astype(np.uint64).view(np.int64)), pa.array(both["b"].astype(np.uint64).view(np.int64))], names=["a", "b"])


def _reaches(shape: Shape, e: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in the tiles [start, end) of entries sorted by tile and size, of sizes that may link, some at a time."""
    reach = np.zeros(len(e), np.int64)
    for s, t in zip(start.tolist(), end.tolist()):
        n = e["n"][s:t].astype(np.int64)
        reach[s:t] = s + np.searchsorted(n, n * 100 // shape.percent, side="right")
    inside = B.spans_of(start, end - start)
    count = np.maximum(reach[inside] - inside - 1, 0)
    for i, j in B.chunks(count, STEP):
        yield np.repeat(inside[i:j], count[i:j]), B.spans_of(inside[i:j] + 1, count[i:j])


def _all_pairs(shape: Shape, e: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in the tiles [start, end) of entries sorted by tile and size, that may link."""
    a, b = [], []
    for left, right in _reaches(shape, e, start, end):
        x, y = e[left], e[right]
        ok = _may_link(shape, x, y)
        a.append(x["set"][ok])
        b.append(y["set"][ok])
        if sum(map(len, a)) > 8 * STEP:
            both = _pairs(np.concatenate(a), np.concatenate(b))
            a, b = [both["a"].to_numpy().view(np.uint64)], [both["b"].to_numpy().view(np.uint64)]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _tiles(shape: Shape, most: int):
    """Pairs of tiles of up to ``most`` sets; of each large tile, or part of one, a pair for each set with the first
    that it may link to, and of the tile itself the sets that may link to others too (with sizes and
    entries), for those that stay apart after that. A part, or a tile too large to look at here, goes on whole."""

    def run(table: pa.Table) -> pa.Table:
        e = B.unpacked(table["part"], ENTRY)
        order = np.lexsort((e["set"], e["n"], e["band"], e["token"]))
        e = e[order]
        same = np.concatenate([[False], (e["set"][1:] == e["set"][:-1]) & (e["token"][1:] == e["token"][:-1]) & (e["band"][1:] == e["band"][:-1])])
        e = e[~same]
        fresh = np.concatenate([[True], (e["token"][1:] != e["token"][:-1]) | (e["band"][1:] != e["band"][:-1])])
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(e))
        size = end - start
        large = (size > most) | (e["parts"][start] > 1)
        small = (size > 1) & ~large
        a, b = _all_pairs(shape, e, start[small], end[small])
        firsts, seconds = [a], [b]
        stay = [np.zeros(0, np.int64)]
        for s, t in zip(start[large].tolist(), end[large].tolist()):
            tile = e[s:t]
            open_, led = np.arange(len(tile)), np.full(len(tile), -1)
            for place in np.argsort(tile["set"])[:most].tolist():
                lead = tile[place]
                ok = _may_link(shape, tile[open_], np.broadcast_to(lead, open_.shape))
                firsts.append(tile["set"][open_[ok]])
                seconds.append(np.full(ok.sum(), lead["set"]))
                led[open_[ok]] = place
                open_ = open_[~ok]
            more = np.full(len(tile), len(tile) > BLOCK or tile["parts"][0] > 1)
            if not more[0]:
                for left, right in _reaches(shape, tile, np.array([0]), np.array([len(tile)])):
                    ok = _may_link(shape, tile[left], tile[right]) & (led[left] != right) & (led[right] != left)
                    more[left[ok]] = more[right[ok]] = True
            stay.append(s + np.flatnonzero(more))
        found = _pairs(np.concatenate(firsts), np.concatenate(seconds))
        found = found.append_column("tile", pa.nulls(len(found), pa.int64())).append_column("entry", pa.nulls(len(found), pa.binary()))
        members = e[np.concatenate(stay)]
        tile = _tile(members).view(np.int64)
        entries = pa.array([x.tobytes() for x in members], pa.binary())
        return pa.concat_tables([found, pa.table([pa.array(members["set"].view(np.int64)), pa.array(members["n"].astype(np.int64)), pa.array(tile), entries], names=found.column_names)])

    return run


def _open_pairs(shape: Shape, e: np.ndarray, label: np.ndarray, side: np.ndarray, apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of a tile's entries (by size) that have different labels and may link; if ``apart``, only of different sides."""
    for left, right in _reaches(shape, e, np.array([0]), np.array([len(e)])):
        other = label[left] != label[right]
        if apart:
            other &= side[left] != side[right]
        left, right = left[other], right[other]
        for k in range(0, len(left), STEP):
            i, j = left[k : k + STEP], right[k : k + STEP]
            ok = _may_link(shape, e[i], e[j])
            yield i[ok], j[ok]


def _by_size(members: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Entries, labels and sides of a tile, by size; the order; and if the sides are two blocks."""
    e = B.unpacked(members["entry"], ENTRY)
    order = np.argsort(e["n"], kind="stable")
    apart = len(e) > 0 and members["lo"][0].as_py() != members["hi"][0].as_py()
    return e[order], members["label"].to_numpy()[order], members["side"].to_numpy()[order], order, apart


def _alive(shape: Shape):
    """The sets of a tile (or of two blocks of it) that may link to one of another component, by brief
    signatures too."""

    def run(members: pa.Table) -> pa.Table:
        e, label, side, order, apart = _by_size(members)
        marks = members["bits"].to_pylist()
        alive, short = np.zeros(len(e), bool), Wide([marks[i] for i in order.tolist()])
        for left, right in _open_pairs(shape, e, label, side, apart):
            n, m = e["n"][left].astype(np.int64), e["n"][right].astype(np.int64)
            ok = short.apart(left, right) <= n + m - 2 * shape.overlap(n, m)
            alive[left[ok]] = alive[right[ok]] = True
        return members.drop_columns(["bits"]).take(pa.array(order[alive]))

    return run


class Forests:
    """Forests over labels: an edge goes into the first whose trees it joins."""

    def __init__(self, labels: np.ndarray, forests: int):
        _, self.node = np.unique(labels, return_inverse=True)
        self.parent = [np.arange(self.node.max(initial=-1) + 1) for _ in range(forests)]

    def root(self, parent: np.ndarray, x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def adds(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of these edges go into a forest."""
        last = self.parent[-1]
        while (last[last] != last).any():
            last[:] = last[last]
        x, y = self.node[i], self.node[j]
        out = np.zeros(len(x), bool)
        for k in np.flatnonzero(last[x] != last[y]).tolist():
            for parent in self.parent:
                a, b = self.root(parent, int(x[k])), self.root(parent, int(y[k]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out[k] = True
                    break
        return out


def _places(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each of the named pairs, from their places among the names."""
    if not len(names) or not len(a):
        return np.zeros(0, np.int64)
    order = np.argsort(names)
    at = [order[np.minimum(np.searchsorted(names, v, sorter=order), len(names) - 1)] for v in (a, b)]
    here = (names[at[0]] == a) & (names[at[1]] == b)
    return (np.minimum(*at) * len(names) + np.maximum(*at))[here]


def _rest(shape: Shape, forests: int):
    """Of the sets of a tile (or of two blocks of it) pairs whose labels differ and whose signatures
    allow a link: as many as make ``forests`` forests over the labels; ``more`` tells if some are
    left. Pairs known not to link are passed over."""

    def run(members: pa.Table, refuted: pa.Table) -> pa.Table:
        e, label, side, order, apart = _by_size(members)
        marks, names = members["wide"].to_pylist(), members["doc_id"].to_numpy()[order]
        wide, trees, no = Wide([marks[i] for i in order.tolist()]), Forests(label, forests), _places(names, refuted["x"].to_numpy(), refuted["y"].to_numpy())
        a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
        for left, right in _open_pairs(shape, e, label, side, apart):
            n, m = e["n"][left].astype(np.int64), e["n"][right].astype(np.int64)
            ok = wide.apart(left, right) <= n + m - 2 * shape.overlap(n, m)
            ok &= ~np.isin(left * len(e) + right, no)
            left, right = left[ok], right[ok]
            new = trees.adds(left, right)
            more |= not new.all()
            a.append(names[left[new]])
            b.append(names[right[new]])
        a, b = np.concatenate(a), np.concatenate(b)
        where = [members[c][0].as_py() if len(e) else 0 for c in ("id", "lo", "hi")]
        return pa.table(
            [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), *(pa.array(np.full(len(a), v, np.int64)) for v in where), pa.array(np.full(len(a), more))],
            names=["x", "y", "id", "lo", "hi", "more"],
        )

    return run


class Wide:
    """Signatures of some sets, by length, which are compared folded to the shorter length."""

    def __init__(self, marks: list[bytes]):
        self.size = np.array([len(m) // 8 for m in marks], np.int64)
        self.row, self.at = np.zeros(len(marks), np.int64), {}
        for size in np.unique(self.size).tolist():
            mine = np.flatnonzero(self.size == size)
            self.row[mine] = np.arange(len(mine))
            self.at[size] = np.frombuffer(b"".join(marks[i] for i in mine.tolist()), "<u8").reshape(len(mine), size)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits by which the signatures of pairs differ."""
        out = np.zeros(len(i), np.int64)
        short, long = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        for size, other in np.unique(np.stack([short, long], axis=1), axis=0).tolist():
            mine = np.flatnonzero((short == size) & (long == other))
            step = max(1, STEP // other)
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                swap = self.size[i[part]] > size
                x, y = np.where(swap, j[part], i[part]), np.where(swap, i[part], j[part])
                folded = np.bitwise_xor.reduce(self.at[other][self.row[y]].reshape(len(part), -1, size), axis=1)
                out[part] = np.bitwise_count(self.at[size][self.row[x]] ^ folded).sum(axis=1)
        return out


def _sieve(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column("slot").to_numpy()])).drop_columns(["slot"])

    return run


def _verify(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                x, y = ([s for block in W.blocks(part.column(c), W.SPACED_LOWER) for s in shingle_sets(block, shape.gram)] for c in ("x_text", "y_text"))
                for row, (s, t) in enumerate(zip(x, y), i):
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    if shared and 100 * shared >= shape.percent * (len(s) + len(t) - shared):
                        keep.append(row)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))

    return run


def _close(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("x_n").to_numpy(), batch.column("y_n").to_numpy()
            most = n + m - 2 * shape.overlap(n, m)
            apart = [bits_apart(x, y) for x, y in zip(batch.column("x_bits").to_pylist(), batch.column("y_bits").to_pylist())]
            yield batch.select(["a", "b", "x", "y"]).filter(pa.array(np.array(apart, np.int64) <= most))

    return run


def _briefs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [brief(bits, n) for bits, n in zip(batch.column("bits").to_pylist(), batch.column("n").to_pylist())]
        yield batch.drop_columns(["bits"]).append_column("bits", pa.array(marks, pa.binary()))


def _brief(sets: DataFrame) -> DataFrame:
    """Sets (set, doc_id, n) with brief signatures (bits)."""
    return sets.filter("doc_id is not null").select("set", "doc_id", "n", "bits").mapInArrow(M.batches(_briefs), "set bigint, doc_id bigint, n bigint, bits binary")


def _near(sets: DataFrame, pairs: DataFrame, shape: Shape) -> DataFrame:
    """(a, b, x, y): pairs of sets whose signatures in ``sets`` allow a link, and their representatives."""
    first, second = (sets.select(F.col("set").alias(a), F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for a, x in (("a", "x"), ("b", "y")))
    met = pairs.join(first, "a").join(second, "b").filter("x <> y").select("a", "b", "x", "y", "x_n", "y_n", "x_bits", "y_bits")
    return met.mapInArrow(M.batches(_close(shape)), "a bigint, b bigint, x bigint, y bigint")


def _candidates(sets: DataFrame, pairs: DataFrame, shape: Shape) -> DataFrame:
    """(x, y), x > y: representatives of pairs of sets whose whole signatures allow a link. Those that
    brief ones rule out go no further, so whole ones move for few sets."""
    near = cut(_near(_brief(sets), pairs.distinct(), shape))
    whole = _rows_of(sets.select("set", "doc_id", "n", "bits"), "set", near.select(F.col("a").alias("set")).union(near.select("b")), "set bigint, doc_id bigint, n bigint, bits binary")
    close = _near(whole, near.select("a", "b").distinct(), shape)
    return cut(close.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())


def _rows_of(df: DataFrame, key: str, ids: DataFrame, schema: str) -> DataFrame:
    """Rows of df that have these keys, and few others."""
    slot = F.xxhash64(key).bitwiseAND(SIEVE_BITS - 1)
    bits = bit_map(slot, ids, SIEVE_BITS)
    return df.filter(F.col(key).isNotNull()).withColumn("slot", slot).mapInArrow(M.batches(_sieve(np.packbits(bits).tobytes())), schema)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of documents of these ids, and of few others."""
    return _rows_of(docs.select("doc_id", "text"), "doc_id", ids, "doc_id bigint, text string")


def _links(docs: DataFrame, pairs: DataFrame, shape: Shape) -> DataFrame:
    """The pairs whose texts link, by exact intersection of sorted sets."""
    texts = _texts_of(docs, pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")))
    met = pairs.join(texts.toDF("x", "x_text"), "x").join(texts.toDF("y", "y_text"), "y")
    return cut(met.select("x", "y", "x_text", "y_text").mapInArrow(M.batches(_verify(shape)), "x bigint, y bigint").distinct())


def _marks(shape: Shape, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for block in W.blocks(batch.column("text"), W.SPACED_LOWER) for s in shingle_sets(block, shape.gram)]
            names = W.signed(np.array([set_hash(s, _SALTS[0]) for s in found], np.uint64))
            yield pa.record_batch([pa.array(names), pa.array([signature(s, wide) for s in found], pa.binary())], names=["set", "wide"])

    return run


def _settled(docs: DataFrame, sets: DataFrame, tiles: DataFrame, close: DataFrame, shape: Shape) -> DataFrame:
    """Components by all pairs of ``close`` that link, and by all that link in large tiles (id, set, n,
    entry).

    Of ``close`` each set's pair with its least partner is decided first, and of the others those
    whose sets are then in different components. Of a large tile with several components the sets
    that may link to one of another component go on to one task with signatures of WIDE places a
    shingle; a very large tile does so in pairs of blocks. Of the pairs that are left there, as many
    are decided in each round as make some forests over the components, so rows grow with a tile
    and not with its pairs. What links joins components; a tile is looked at again only where a pair
    did not link and others were left, then with 16 times as many forests.
    """
    known = cut(components(_links(docs, close.groupBy("x").agg(F.min("y").alias("y")), shape)))
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    both = close.join(of("x"), "x", "left").join(of("y"), "y", "left")
    more = cut(both.filter(F.coalesce("x_in", "x") != F.coalesce("y_in", "y")).select("x", "y"))
    if more.take(1):
        known = cut(components(known.union(_links(docs, more, shape))))

    named = sets.filter("doc_id is not null").join(known, F.col("doc_id") == F.col("node"), "left")
    named = named.groupBy("set").agg(F.min(F.coalesce("component", "doc_id")).alias("label"))
    split = tiles.join(named, "set").join(_brief(sets).select("set", "bits").dropDuplicates(["set"]), "set")
    several = split.groupBy("id").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = split.join(several.filter("l <> h").select("id", "blocks"), "id").withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("id", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), (F.col("own") > F.col("other")).alias("side"), "set", "label", "entry", "bits")
    schema = "id bigint, lo bigint, hi bigint, side boolean, set bigint, label bigint, entry binary"
    alive = cut(members.groupBy("id", "lo", "hi").applyInArrow(M.group(_alive(shape)), schema))
    if not alive.take(1):
        return known
    wanted = cut(sets.filter("doc_id is not null").join(alive.select("set").distinct(), "set").select("set", "doc_id"))
    wide = _texts_of(docs, wanted.select("doc_id")).mapInArrow(M.batches(_marks(shape, WIDE)), "set bigint, wide binary")
    members = cut(alive.drop("label").join(wide.join(wanted, "set").dropDuplicates(["set", "doc_id"]), "set"))
    key, forests = ["id", "lo", "hi"], 4
    refuted = docs.sparkSession.createDataFrame([], "id bigint, lo bigint, hi bigint, x bigint, y bigint")
    while True:
        named = wanted.join(known, F.col("doc_id") == F.col("node"), "left").select(F.col("doc_id").alias("d"), F.coalesce("component", "doc_id").alias("label")).distinct()
        labelled = members.join(named, F.col("doc_id") == F.col("d")).drop("d")
        schema = "x bigint, y bigint, id bigint, lo bigint, hi bigint, more boolean"
        rest = cut(labelled.groupBy(*key).cogroup(refuted.groupBy(*key)).applyInArrow(M.cogroup(_rest(shape, forests)), schema))
        found = _links(docs, rest.select("x", "y").distinct(), shape)
        failed = cut(rest.join(found, ["x", "y"], "left_anti"))
        known = cut(components(known.union(found)))
        again = failed.filter("more").select(*key).distinct().toDF(*key)
        if not failed.filter("more").take(1):
            return known
        members = cut(members.join(again, key)).toDF(*members.columns)
        lost = failed.select("x", "y").union(refuted.select("x", "y")).distinct()
        refuted = cut(members.select(*key, F.col("doc_id").alias("x")).join(lost, "x").select(*key, "x", "y")).toDF(*key, "x", "y")
        forests *= 16


def jaccard_components(docs: DataFrame, gram: int = 3, percent: int = 90, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Two texts link if ``100 * shared >= percent * union`` for their sets of distinct ``gram``-word
    shingles (ASCII white space parts words; A-Z count as a-z; all words as one shingle if fewer).

    Equal sets count once. Of each set the rarest shingles are tokens, so many that two sets that
    link share one; "rare" is by counts of all documents in fixed slots. A tile holds the sets of a
    token (of a common token: those of a size band and its neighbour). In a tile, sizes, the
    token's places and the bits by which two signatures differ bound the overlap from above: in the
    tile 128 bits of the shingles from the token on, then a place for BRIEF shingles, then as many
    places as a set has shingles. Pairs that remain are decided by
    intersecting their sorted sets, for each set first the pair with its least partner.

    Large tiles first offer each set one pair; the tile of a very common token does so in parts. Only
    where sets are then in different components, and their signatures allow a link, are they
    compared with all others of the tile (see _settled), so that a large group of near copies never
    sends out all its pairs, and no link between components is lost.

    A null, empty or blank text has no shingles and links with nothing. Rows that share a doc_id
    are one document in links. A row without doc_id takes the component of its equal texts, null if
    they have none. An empty table gives an empty result. Other columns are ignored.
    """
    doc_id, text = columns
    shape = Shape(gram, percent)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = cut(docs.mapInArrow(M.batches(_describe(gram)), "doc_id bigint, n bigint, set bigint, set2 bigint, bits binary, slot bigint, times bigint"))
    rows = described.filter("slot is null").select("doc_id", "n", "set", "set2", "bits")
    sets = cut(rows.filter("n > 0").groupBy("n", "set", "set2").agg(F.min("doc_id").alias("doc_id"), F.first("bits").alias("bits")))

    ranks, parts = np.zeros(SLOTS, np.uint16), np.ones(COMMON + 1, np.uint16)
    common = described.filter("slot is not null").groupBy("slot").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "slot").limit(COMMON).collect()
    for place, row in enumerate(common):
        ranks[row.slot] = COMMON - place
        parts[COMMON - place] = min(row.times // PART + 1, 1 << 15)
    entries = sets.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    buckets = max(16, int(entries * ENTRY.itemsize / BUCKET_BYTES))
    found = docs.select("text").mapInArrow(M.batches(_entries(shape, ranks, parts, buckets)), B.SCHEMA).groupBy("bucket").applyInArrow(M.group(_tiles(shape, SMALL_TILE)), "a bigint, b bigint, tile bigint, entry binary")
    found = cut(found)
    close = _candidates(sets, found.filter("tile is null").select("a", "b"), shape)
    known = _settled(docs, sets, found.filter("tile is not null").select(F.col("tile").alias("id"), F.col("a").alias("set"), F.col("b").alias("n"), "entry"), close, shape)

    out = rows.drop("bits").join(sets.select("n", "set", "set2", F.col("doc_id").alias("first")), ["n", "set", "set2"], "left").join(known, F.col("first") == F.col("node"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
