"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import _memory as M
from lanewise.llm import _words as W
from lanewise.llm._tables import bit_map, cut

#: Words of a shared span that is surely found, and words of a fingerprint.
SPAN, GRAM = 8, 5
#: Bits of the map of item fingerprints that texts are sieved with; a fixed size, whatever the items.
SIEVE_BITS = 1 << 23

_HIT = pa.struct([("family", pa.int32()), ("print", pa.int64()), ("at", pa.int64()), ("around", pa.binary())])


def _prints(block: W.Block, span: int, gram: int, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(family, text, word, hash) of the fingerprints of a block.

    Family ``span``: the smallest gram hash of every ``span`` consecutive words. A family below it,
    for items of so many words: each gram of that length.
    """
    text_of = block.text_of_word()
    for family in [span, *lengths]:
        k = gram if family == span else family
        hashes = W.gram_hashes(block.hashes, k, seed=family)
        inside = W.gram_starts(block.word_at, k)
        at = W.winnow(hashes, span - gram + 1, inside) if family == span else np.flatnonzero(inside)
        yield family, text_of[at], at, hashes[at]


def _around(block: W.Block, text: np.ndarray, at: np.ndarray, family: int, span: int, gram: int) -> np.ndarray:
    """Hashes of the words that a window over the fingerprint can hold; 0 outside the text."""
    lead = span - gram if family == span else 0
    width = 2 * span - gram if family == span else family
    index = at[:, None] + np.arange(-lead, width - lead)
    inside = (index >= block.word_at[text][:, None]) & (index < block.word_at[text + 1][:, None])
    return np.where(inside, block.hashes[np.clip(index, 0, len(block.hashes) - 1)], np.uint64(0))


def _item_prints(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id")
            for block in W.blocks(batch.column("text"), W.ALNUM_LOWER):
                count = np.diff(block.word_at)
                short = [int(x) for x in np.unique(count) if 0 < x < span]
                for family, text, at, hashes in _prints(block, span, gram, short):
                    own = (count[text] >= span) if family == span else (count[text] == family)
                    text, at, hashes = text[own], at[own], hashes[own]
                    around = _around(block, text, at, family, span, gram)
                    yield pa.record_batch(
                        [ids.take(pa.array(block.first + text)), pa.array(np.full(len(at), family, np.int32)), pa.array(W.signed(hashes)), pa.array([x.tobytes() for x in around], pa.binary())],
                        names=["item_id", "family", "print", "around"],
                    )

    return run


def _text_prints(span: int, gram: int, short: list[int], sieve: bytes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(sieve, np.uint8)).view(bool)
        for batch in batches:
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            words = np.zeros(batch.num_rows, np.int64)
            for block in W.blocks(batch.column("text"), W.ALNUM_LOWER):
                words[block.first : block.first + len(block)] = np.diff(block.word_at)
                for family, text, at, hashes in _prints(block, span, gram, short):
                    maybe = known[hashes & np.uint64(bits - 1)]
                    text, at, hashes = text[maybe], at[maybe], hashes[maybe]
                    around = _around(block, text, at, family, span, gram) if len(at) else []
                    for t, word, h, near in zip(text.tolist(), (at - block.word_at[text]).tolist(), W.signed(hashes).tolist(), around):
                        hits[block.first + t].append({"family": family, "print": h, "at": word, "around": near.tobytes()})
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(words), pa.array(hits, pa.list_(_HIT))], names=["doc_id", "key", "n_words", "hits"])

    return run


def _extend(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items, at, family = batch.column("key"), batch.column("item_id"), batch.column("at").to_numpy(), batch.column("family").to_numpy()
            ours, theirs = batch.column("around").to_pylist(), batch.column("i_around").to_pylist()
            for f in np.unique(family).tolist():
                rows = np.flatnonzero(family == f)
                a, b = (np.frombuffer(b"".join(x[i] for i in rows), np.uint64).reshape(len(rows), -1) for x in (ours, theirs))
                same = (a == b) & (a != 0)
                lead = span - gram if f == span else 0
                runs = np.concatenate([np.zeros((len(rows), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
                row, shift = np.nonzero(runs[:, f:] - runs[:, :-f] == f)
                start = at[rows[row]] - lead + shift
                if len(row):
                    where = pa.array(rows[row])
                    yield pa.record_batch([keys.take(where), items.take(where), pa.array(start), pa.array(start + f)], names=["key", "item_id", "start", "stop"])

    return run


def shared_windows(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, columns: tuple[str, str, str, str] = ("doc_id", "text", "item_id", "text")) -> tuple[DataFrame, DataFrame]:
    """(texts, windows): each row of docs with its key and n_words; and each window of an item that
    occurs in a text: key, item_id, start, stop (words from 0, end exclusive).

    Any ``span - gram + 1`` consecutive grams hold a kept fingerprint, so each window of ``span``
    words has one, and it is the same in the text and in the item. Fingerprints go with the words
    that windows over them can hold. The items' fingerprints set bits of a map of fixed size, by
    which texts are sieved before fingerprints meet in a join; each meeting is then extended to
    whole windows word by word. Items of fewer words are windows themselves: their length is a
    family of its own in which every gram is kept.
    """
    doc_id, text, item_id, item_text = columns
    schema = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    kind = schema.schema["item_id"].dataType.simpleString()
    prints = schema.mapInArrow(M.batches(_item_prints(span, gram)), f"item_id {kind}, family int, print bigint, around binary").distinct()
    prints = cut(prints)
    sieve = bit_map(F.col("print").bitwiseAND(SIEVE_BITS - 1), prints, SIEVE_BITS)
    short = sorted(r.family for r in prints.select("family").distinct().collect() if r.family < span)

    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key"))
    texts = texts.mapInArrow(
        M.batches(_text_prints(span, gram, short, np.packbits(sieve).tobytes(), SIEVE_BITS)),
        f"doc_id {kind}, key string, n_words bigint, hits array<struct<family:int,print:bigint,at:bigint,around:binary>>",
    )
    texts = cut(texts)
    # texts that many documents share meet the items once
    hits = texts.filter(F.size("hits") > 0).select("key", "hits").dropDuplicates(["key"]).select("key", F.inline("hits"))
    met = hits.join(prints.withColumnRenamed("around", "i_around"), ["family", "print"])
    kind = prints.schema["item_id"].dataType.simpleString()
    windows = met.select("key", "item_id", "at", "family", "around", "i_around").mapInArrow(M.batches(_extend(span, gram)), f"key string, item_id {kind}, start bigint, stop bigint")
    return texts.drop("hits"), windows.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, min_items: int = 2, span: int = SPAN, gram: int = GRAM, columns: tuple[str, str, str, str] = ("doc_id", "text", "item_id", "text")) -> DataFrame:
    """For each row of docs: doc_id, key (sha256 of the text), n_words, n_hit (words inside an
    occurrence of an item's window), n_items, items (their ids as strings, sorted), contaminated
    (n_items >= min_items).

    A null or wordless text has no words and no hits; rows alike are judged alike, each by itself.
    An item with a null id or text takes no part, and equal ids are one item. Empty tables give no
    rows, or no hits. Other columns are ignored.
    """
    texts, windows = shared_windows(docs, items, span, gram, columns)
    found = windows.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["stop"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"],
    )
    found = found.select("key", covered.alias("n_hit"), "items")
    out = texts.join(found, "key", "left")
    items_col = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_col).cast("long").alias("n_items"), items_col.alias("items"), (F.size(items_col) >= min_items).alias("contaminated"))
