"""Line dedup: fuzzy lines by MinHash, exact Jaccard verification, and one line kept for each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm import _memory as M
from lanewise.llm import _buckets as B
from lanewise.llm import _words as W
from lanewise.llm._tables import bit_map, cut, small_or_shuffled, written
from lanewise.llm.components import components

#: Characters of a shingle; bands, and minima that make a band.
SHINGLE, BANDS, ROWS = 5, 20, 6
#: Bytes of band entries that a bucket holds on average, and lines of a band that are all paired at once.
BUCKET_BYTES, SMALL_BAND = 12 << 20, 16
#: Lines, and characters of lines, of a band that one task compares with so many others.
BLOCK, BLOCK_CHARS = 2048, 1 << 21
SIEVE_BITS = 1 << 23

ENTRY = np.dtype([("line", "<u8"), ("band", "<u4")])
_LAST = (1 << 63) - 1
_BINS = BANDS * ROWS
#: Bits of a minimum, and lines of which minima are told apart in 32 bits together with them.
_MINIMUM, _AT_ONCE = 14, (1 << 18) // _BINS - 1
_EMPTY = np.uint32(1 << 31)
#: Words of a signature whose bits are parities of shingles.
_PARITY = 512


class Lines(W.WordClass):
    """Lines taken as words: runs of anything but line feeds."""


_mask = np.ones(256, bool)
_mask[0x0A] = False
LINES = Lines(_mask, lower=False)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def line_blocks(column: pa.Array) -> Iterator[tuple[W.Block, np.ndarray]]:
    """(block, number of each line in its text); its "words" are the lines with more than white space."""
    for first, buf, text_at in W.text_groups(column):
        feeds = np.flatnonzero(buf == 0x0A)
        lines = np.diff(np.searchsorted(feeds, text_at)) + 1
        # a text's last line ends with it, the others at a feed, and so in order
        start, end = np.sort(np.concatenate([text_at[:-1], feeds + 1])), np.sort(np.concatenate([feeds, text_at[1:]]))
        number = np.arange(len(start)) - np.repeat(np.cumsum(lines) - lines, lines)
        keep = end > start
        keep[keep] = ~_BLANK[buf[start[keep]]]
        for i in np.flatnonzero(~keep & (end > start)).tolist():
            keep[i] = not _BLANK[buf[start[i] : end[i]]].all()
        text = np.repeat(np.arange(len(lines)), lines)[keep]
        start, end = start[keep], end[keep]
        yield W.Block(first, buf, text_at, start, end, np.searchsorted(text, np.arange(len(lines) + 1)), W.span_hashes(LINES, buf, start, end)), number[keep]


_CODES = W.mix64(np.arange(1, 65537, dtype=np.uint64))


def _runs(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive codes, by doubling."""
    h, length, radix = _CODES[code] if not len(code) or code.max() < len(_CODES) else W.mix64(code.astype(np.uint64) + np.uint64(1)), 1, int(W._GRAM)
    out, done = None, 0
    while length <= size:
        if size & length:
            part = h[done : len(code) - size + 1 + done]
            out = part.copy() if out is None else out * np.uint64(pow(radix, length, 1 << 64)) + part
            done += length
        if 2 * length <= size:
            h = h[:-length] * np.uint64(pow(radix, length, 1 << 64)) + h[length:]
        length *= 2
    return W.mix64(out)


def shingle_hashes(line: str, size: int) -> np.ndarray:
    """A hash of each run of ``size`` characters; of a shorter line, one hash."""
    code = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4")
    return _runs(code, min(size, len(code))) + np.uint64(min(size, len(code)))


_SHORT_CODES = (_CODES >> np.uint64(32)).astype(np.uint32)
_SHORT_RADIX = 0x9E3779B1


def _short_runs(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of 32 bits of each ``size`` consecutive codes, for minima; by doubling."""
    h, length = _SHORT_CODES[code & np.uint32(0xFFFF)], 1
    if len(code) and code.max() > 0xFFFF:
        h = h + (code >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    out, done = None, 0
    while length <= size:
        power = np.uint32(pow(_SHORT_RADIX, length, 1 << 32))
        if size & length:
            part = h[done : len(code) - size + 1 + done]
            out = part.copy() if out is None else out * power + part
            done += length
        if 2 * length <= size:
            h = h[:-length] * power + h[length:]
        length *= 2
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x7FEB352D)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x846CA68B)
    out ^= out >> np.uint32(16)
    return out


def signatures(code: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """One-permutation MinHash of each line [start, end) of the codes: the least shingle hash in each
    of the bins, empty bins filled from others in an order that depends on the bin alone."""
    lines = len(start)
    out = np.full(lines * _BINS, _EMPTY, np.uint32)
    whole = _short_runs(code, size) if len(code) >= size else np.zeros(0, np.uint32)
    for a in range(0, lines, _AT_ONCE):
        b = min(lines, a + _AT_ONCE)
        count = np.maximum(end[a:b] - start[a:b] - size + 1, 0)
        line = np.repeat(np.arange(b - a, dtype=np.uint32) * np.uint32(_BINS), count)
        ends = np.cumsum(count)
        h = whole[np.arange(len(line), dtype=np.int32) + np.repeat((start[a:b] - (ends - count)).astype(np.int32), count)]
        short = np.flatnonzero(count == 0)
        if len(short):
            each = [int(_short_runs(code[start[a + i] : end[a + i]], int(end[a + i] - start[a + i]))[0]) for i in short.tolist()]
            line, h = np.append(line, short.astype(np.uint32) * np.uint32(_BINS)), np.append(h, np.array(each, np.uint32))
        bins = ((h >> np.uint32(16)) * np.uint32(_BINS)) >> np.uint32(16)
        key = np.sort(((line + bins) << np.uint32(_MINIMUM)) | (h & np.uint32((1 << _MINIMUM) - 1)))
        slot = key >> np.uint32(_MINIMUM)
        first = np.flatnonzero(slot[1:] != slot[:-1]) + 1
        first = np.concatenate([[0], first]) if len(key) else first
        out[a * _BINS + slot[first].astype(np.int64)] = key[first] & np.uint32((1 << _MINIMUM) - 1)
    out = out.reshape(lines, _BINS)
    row, col = np.nonzero(out == _EMPTY)
    source, step = out.copy(), 0
    while len(row):
        step += 1
        other = (W.mix64(np.arange(_BINS, dtype=np.uint64) * np.uint64(4096) + np.uint64(step)) % np.uint64(_BINS)).astype(np.int64)[col] if step < 4096 else (col + step) % _BINS
        value = source[row, other]
        out[row, col] = value
        row, col = row[value == _EMPTY], col[value == _EMPTY]
    return out


_WEIGHTS = W.mix64(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND_SALTS = W.mix64(np.arange(101, BANDS + 101, dtype=np.uint64))


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A hash for each line and band of its minima."""
    total = np.zeros((len(sig), BANDS), np.uint64) + _BAND_SALTS
    for r in range(ROWS):
        total += sig[:, r::ROWS].astype(np.uint64) * _WEIGHTS[r]
    return W.mix64(total)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, number in line_blocks(batch.column("text")):
            row = pa.array(block.first + block.text_of_word())
            yield pa.record_batch([batch.column("doc").take(row), batch.column("key").take(row), pa.array(number), pa.array(W.signed(block.hashes)), pa.array(W.signed(W.second_hashes(block)))], names=["doc", "key", "at", "line", "line2"])


def _bands(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            parts = []
            for block, _ in line_blocks(batch.column("text")):
                _, first = np.unique(block.hashes, return_index=True)
                first = np.array([i for i, h in zip(first.tolist(), block.hashes[first].tolist()) if h not in done], np.int64)
                if not len(first):
                    continue
                names = block.hashes[first]
                done.update(names.tolist())
                code = np.frombuffer(block.buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
                place = np.concatenate([np.zeros(1, np.int32), np.cumsum((block.buf & 0xC0) != 0x80, dtype=np.int32)])
                sig = signatures(code, place[block.start[first]], place[block.end[first]], size)
                total = band_hashes(sig)
                e, bucket = np.zeros((len(names), BANDS), ENTRY), (total % np.uint64(buckets)).astype(np.int64)
                e["line"], e["band"] = names[:, None], total >> np.uint64(32)
                parts.append((bucket.reshape(-1), e.reshape(-1)))
            if parts:
                yield B.packed(*(np.concatenate(x) for x in zip(*parts)))

    return run


def _meet(most: int):
    """All pairs of a band of up to ``most`` lines; of a larger one each line with the first, and then its
    lines without a partner."""

    def run(table: pa.Table) -> pa.Table:
        e = B.unpacked(table["part"], ENTRY)
        e = e[np.lexsort((e["line"], e["band"]))]
        if len(e):
            e = e[np.concatenate([[True], (e["band"][1:] != e["band"][:-1]) | (e["line"][1:] != e["line"][:-1])])]
        start, end = B.groups(e["band"])
        size = end - start
        small, large = (size > 1) & (size <= most), size > most
        inside = B.spans_of(start[small], size[small])
        later = np.repeat(end[small], size[small]) - inside - 1
        first, second = [], []
        for i, j in B.chunks(later, 1 << 20):
            x, y = np.repeat(inside[i:j], later[i:j]), B.spans_of(inside[i:j] + 1, later[i:j])
            first.append(e["line"][x])
            second.append(e["line"][y])
        rest = B.spans_of(start[large] + 1, size[large] - 1)
        first.append(np.repeat(e["line"][start[large]], size[large] - 1))
        second.append(e["line"][rest])
        members = e[B.spans_of(start[large], size[large])]
        signed = lambda x: np.ascontiguousarray(x).astype(np.uint64).view(np.int64)
        a, b = (signed(np.concatenate(x or [np.zeros(0, np.uint64)])) for x in (second, first))
        a, b = np.maximum(a, b), np.minimum(a, b)
        bucket = np.uint64(table["bucket"][0].as_py() if len(table) else 0) << np.uint64(32)
        lone = np.concatenate([np.zeros(len(a), bool), np.ones(len(members), bool)])
        band = np.concatenate([np.zeros(len(a), np.int64), signed(bucket | members["band"].astype(np.uint64))])
        line, other = np.concatenate([a, signed(members["line"])]), np.concatenate([b, np.zeros(len(members), np.int64)])
        return pa.table([pa.array(line), pa.array(other, mask=lone), pa.array(band, mask=~lone)], names=["a", "b", "band"])

    return run


def _wanted(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool), set()
        for batch in batches:
            lines, others, texts = [], [], []
            for block, _ in line_blocks(batch.column("text")):
                raw = block.buf.tobytes()
                found = np.flatnonzero(known[block.hashes & np.uint64(SIEVE_BITS - 1)])
                second = W.signed(W.second_hashes(block, found)).tolist()
                for name, other, a, b in zip(W.signed(block.hashes[found]).tolist(), second, block.start[found].tolist(), block.end[found].tolist()):
                    if (name, other) not in done:
                        done.add((name, other))
                        lines.append(name)
                        others.append(other)
                        texts.append(raw[a:b].decode("utf-8", "replace"))
            yield pa.record_batch([pa.array(lines, pa.int64()), pa.array(others, pa.int64()), pa.array(texts, pa.string())], names=["line", "line2", "text"])

    return run


def shingle_sets(lines: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each line."""
    codes = [line.encode("utf-32-le", "replace") for line in lines]
    length = np.array([len(c) // 4 for c in codes], np.int64)
    start = np.cumsum(length) - length
    code = np.frombuffer(b"".join(codes), "<u4")
    whole = _runs(code, size) + np.uint64(size) if len(code) >= size else np.zeros(0, np.uint64)
    out = []
    for a, n in zip(start.tolist(), length.tolist()):
        s = np.sort(whole[a : a + n - size + 1]) if n >= size else _runs(code[a : a + n], n) + np.uint64(n)
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = np.sort(np.concatenate([s, t]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(s) + len(t) - shared)


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 1000):
                # a line is often in several pairs
                part = batch.slice(i, 1000)
                both = pa.concat_arrays([part.column("x_text"), part.column("y_text")])
                _, first, at = np.unique(np.concatenate([part.column(c).to_numpy() for c in ("a", "b")]), return_index=True, return_inverse=True)
                sets = shingle_sets(both.take(pa.array(first)).to_pylist(), size)
                rows = part.num_rows
                keep += [i + row for row, (x, y) in enumerate(zip(at[:rows].tolist(), at[rows:].tolist())) if _linked(sets[x], sets[y], percent)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _settle(size: int, percent: int):
    """Links in a band (or between two blocks of it) that join its parts (labels): lines of different
    parts are compared until a link joins them. Sizes and parities of shingles rule most pairs out;
    the sets decide the rest."""

    def run(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table["text"].to_pylist(), size)
        n = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(n, kind="stable")
        n, sets = n[order], [sets[i] for i in order.tolist()]
        names, side = (table[c].to_numpy()[order] for c in ("line", "side"))
        apart = (table["lo"][0].as_py() != table["hi"][0].as_py()) if len(table) else False
        bits = np.array([np.packbits(np.bincount((s % np.uint64(_PARITY)).astype(np.int64), minlength=_PARITY) & 1).view("<u8") for s in sets])
        _, part = np.unique(table["label"].to_numpy()[order], return_inverse=True)
        parent = np.arange(part.max(initial=-1) + 1)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        reach = np.searchsorted(n, n * 100 // percent, side="right")
        count = np.maximum(reach - np.arange(len(n)) - 1, 0)
        a, b = [], []
        for i, j in B.chunks(count, 1 << 18):
            x, y = np.repeat(np.arange(i, j), count[i:j]), B.spans_of(np.arange(i, j) + 1, count[i:j])
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
            ok = parent[part[x]] != parent[part[y]]
            if apart:
                ok &= side[x] != side[y]
            x, y = x[ok], y[ok]
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            ok = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= n[x] + n[y] - 2 * need
            for v, w in zip(x[ok].tolist(), y[ok].tolist()):
                p, q = root(int(part[v])), root(int(part[w]))
                if p != q and _linked(sets[v], sets[w], percent):
                    parent[max(p, q)] = min(p, q)
                    a.append(names[v])
                    b.append(names[w])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def similar_lines(docs: DataFrame, lines: int, size: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(line, line2, component): both hashes of different lines that are linked by similar ones, and
    a number for each component. ``lines``: how many there are, to deal them by.

    Bands name lines by one hash. Lines that meet there are looked up with both and get numbers of
    their own, so that lines of equal first hashes stay different lines from then on.
    """
    buckets = max(8, lines * BANDS * ENTRY.itemsize // BUCKET_BYTES)
    found = written(docs.select("text").mapInArrow(M.batches(_bands(size, buckets)), B.SCHEMA).groupBy("bucket").applyInArrow(M.group(_meet(SMALL_BAND)), "a bigint, b bigint, band bigint"))
    pairs = written(found.filter("band is null").select("a", "b").distinct())
    # lines of large bands are in pairs too
    bits = bit_map(F.col("line").bitwiseAND(SIEVE_BITS - 1), pairs.select(F.explode(F.array("a", "b")).alias("line")), SIEVE_BITS)
    texts = docs.select("text").mapInArrow(M.batches(_wanted(np.packbits(bits).tobytes())), "line bigint, line2 bigint, text string")
    # one shuffle and one sort serve both: each line once, and numbers, which are the first hash, or of both for a further line of it
    texts = texts.repartition("line").sortWithinPartitions("line", "line2").dropDuplicates(["line", "line2"])
    further = F.lag("line2").over(Window.partitionBy("line").orderBy("line2")).isNotNull()
    texts = written(texts.withColumn("id", F.when(further, F.xxhash64("line", "line2")).otherwise(F.col("line"))))

    def verified(some: DataFrame) -> DataFrame:
        # lines of one first hash stand wherever it does
        x, y = (texts.select(F.col("line").alias(i), F.col("id").alias(f"{c}_id"), F.col("text").alias(f"{c}_text")) for c, i in (("x", "a"), ("y", "b")))
        met = some.join(x, "a").join(y, "b").select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), "x_text", "y_text")
        return written(met.mapInArrow(M.batches(_verify(size, percent)), "a bigint, b bigint"))

    known = cut(components(verified(pairs)))
    twins = small_or_shuffled(texts.filter("id <> line").select(F.col("line").alias("a"), "id"))
    large = found.filter("band is not null").select("a", "band").join(twins, "a", "left")
    large = large.select(F.explode(F.when(F.col("id").isNull(), F.array("a")).otherwise(F.array("a", "id"))).alias("line"), "band")
    members = large.join(small_or_shuffled(known), F.col("line") == F.col("node"), "left").select("band", "line", F.coalesce("component", "line").alias("label"))
    several = members.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.bit_xor(F.xxhash64("line")).alias("lines"), F.count("*").alias("n"))
    # similar lines often share several bands: of bands with the same lines one is enough
    several = cut(several.filter("l <> h").groupBy("lines", "n").agg(F.min("band").alias("band")).select("band"))
    if several.take(1):
        open_ = written(members.join(several.toDF("band"), "band").join(texts.select(F.col("id").alias("line"), "text"), "line"))
        sizes = open_.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("text")) / BLOCK_CHARS)).cast("int").alias("blocks"))
        dealt = open_.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("band", "line", "label", "text", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("side"))
        settled = written(dealt.groupBy("band", "lo", "hi").applyInArrow(M.group(_settle(size, percent)), "a bigint, b bigint"))
        if settled.take(1):
            known = cut(components(known.union(settled)))
    named = known.union(known.select("component", "component").distinct())
    return named.join(texts.select("id", "line", "line2"), F.col("node") == F.col("id")).select("line", "line2", "component")


def dedup_lines(docs: DataFrame, size: int = SHINGLE, percent: int = 80, columns: tuple[str, str] = ("doc_id", "text"), carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: doc_id, text (without the lines that repeat earlier ones), n_lines
    (before), dropped (places of the lines that went, from 0, or null), and the columns ``carry``
    in a struct named rest (null without any).

    Lines are parted by line feeds. Two lines link if they are equal, or if ``percent`` hundredths
    of their distinct runs of ``size`` characters are common. Of each component the first line, by
    document id and place, stays.

    A line's runs of characters give minima in 120 bins of one hash function, and these 20 bands of
    6: a pair at similarity 0.8 shares a band with probability 0.998, one at 0.3 with 0.015. Pairs
    that share one are decided exactly; of a large band each line first has one pair. If its lines are
    then in different components, they are compared until links join these or none is left to
    compare, a very large band in pairs of blocks, so that a large group of similar lines never sends
    out all its pairs. Lines are told by 128 bits and count once in all of this; a line that is in very many
    documents is one row of every join but the last, which Spark splits, as the other side has one
    row for it.

    Blank lines always stay, also of empty texts; null text stays null and has no lines. Rows
    without id come after all others. Rows that share an id and the text are one document: the line
    kept in one is kept in each of them. Of different texts with one id, or with none, each is a
    document of its own, ordered by a hash of the text. An empty table gives an empty result. Other columns are ignored.
    """
    doc_id, text = columns
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("key"), rest.alias("rest"))
    occurrences = written(named.select("doc", "key", "text").mapInArrow(M.batches(_occurrences), "doc bigint, key bigint, at bigint, line bigint, line2 bigint"))
    known = similar_lines(named, occurrences.count(), size, percent)
    lines = occurrences.groupBy("line", "line2").agg(F.count("*").alias("n")).join(known, ["line", "line2"], "left").filter("n > 1 or component is not null")
    # tables in between, as Spark splits a task of many equal keys only where both sides of a join come straight from shuffles
    lines = written(lines.select("line", "line2", F.coalesce("component", "line").alias("part"), F.when(F.col("component").isNull(), F.col("line2")).otherwise(0).alias("part2")))
    repeated = written(occurrences.join(lines, ["line", "line2"]).select("doc", "key", "at", "part", "part2"))
    stays = written(repeated.groupBy("part", "part2").agg(F.min(F.struct("doc", "key", "at")).alias("stays")))
    gone = repeated.join(stays, ["part", "part2"]).filter(F.struct("doc", "key", "at") != F.col("stays")).groupBy("doc", "key").agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    each = F.split("text", "\n", -1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    left = F.array_join(F.filter(each, lambda x, i: ~F.array_contains("dropped", i.cast("long"))), "\n")
    return named.join(gone, ["doc", "key"], "left").select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("text"), n_lines.alias("n_lines"), "dropped", "rest"
    )
