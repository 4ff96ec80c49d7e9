"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, joined by shards of counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lanewise.llm import _memory as M
from lanewise.llm import _buckets as B
from lanewise.llm import _words as W
from lanewise.llm._tables import cut, written

#: Characters of the longest gram; bytes of text in a group of documents.
ORDER, GROUP_BYTES = 4, 8 << 20
#: Held-back trusted documents below which a language takes the limit of all languages.
FEW = 20
#: What stands before a text.
PAD = "\n"


class Grams:
    """The grams of some texts, each text led by ORDER - 1 pads: ids of distinct grams by place."""

    def __init__(self, texts: list[str]):
        self.all = "".join(PAD * (ORDER - 1) + t for t in texts)
        code = np.frombuffer(self.all.encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(length + ORDER - 1) - length - (ORDER - 1)
        letters = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
        letters[code] = True
        index = (np.cumsum(letters, dtype=np.uint32) - np.uint32(1))[code]
        size = int(letters.sum())
        n = max(0, len(code) - ORDER + 1)
        ids = np.zeros(n, np.uint32 if size <= 256 else np.uint64)
        for j in range(ORDER):
            ids = ids * ids.dtype.type(size) + index[j : j + n].astype(ids.dtype) if size <= 65536 else W.mix64(ids.astype(np.uint64)) + index[j : j + n].astype(np.uint64)
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, start, 1)
        np.add.at(inside, np.minimum(start + length, n), -1)
        self.at = np.flatnonzero(np.cumsum(inside[:n]) > 0)
        self.ids = ids[self.at]
        self.edges = np.concatenate([[0], np.cumsum(length)])

    def distinct(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct grams, the gram at each place, and how often each occurs."""
        _, first, inverse, count = np.unique(self.ids, return_index=True, return_inverse=True, return_counts=True)
        return [self.all[a : a + ORDER] for a in self.at[first].tolist()], inverse, count


def _texts(column: pa.ChunkedArray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows and texts, up to half a million characters at once."""
    rows, texts, size = [], [], 0
    for row in np.flatnonzero(chosen).tolist():
        text = column[row].as_py()
        rows.append(row)
        texts.append(text)
        size += len(text)
        if size > 1 << 19:
            yield np.array(rows), texts
            rows, texts, size = [], [], 0
    if rows:
        yield np.array(rows), texts


def _count(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Counts of the grams of a group's trusted documents, and of all its distinct grams (as 0)."""
    docs = B.dealt_rows(docs["part"])
    if docs is None:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.int64())], names=["g", "gram", "n"])
    good = np.isin(docs["doc"].to_numpy(), trusted["doc"].to_numpy())
    counts: dict[str, int] = {}
    for mine, weight in ((good, 1), (~good, 0)):
        for _, texts in _texts(docs["text"], mine):
            grams, _, times = Grams(texts).distinct()
            for g, c in zip(grams, (times * weight).tolist()):
                counts[g] = counts.get(g, 0) + c
    pa.default_memory_pool().release_unused()
    return pa.table([pa.array(np.full(len(counts), docs["g"][0].as_py())), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["g", "gram", "n"])


def _score(kind: pa.DataType, lang: pa.DataType):
    names = ["doc_id", "doc", "lang", "key", "n_chars", "cost"]

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs = B.dealt_rows(docs["part"])
        if docs is None:
            return pa.table([pa.array([], t) for t in (kind, pa.int64(), lang, pa.string(), pa.int64(), pa.float64())], names=names)
        cost = dict(zip(known["gram"].to_pylist(), known["cost"].to_pylist()))
        total, chars = np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        for rows, texts in _texts(docs["text"], np.ones(len(docs), bool)):
            grams = Grams(texts)
            found, inverse, _ = grams.distinct()
            each = np.array([cost[g] for g in found])[inverse] if found else np.zeros(0)
            sums = np.concatenate([[0.0], np.cumsum(each)])
            total[rows], chars[rows] = sums[grams.edges[1:]] - sums[grams.edges[:-1]], np.diff(grams.edges)
        pa.default_memory_pool().release_unused()
        return pa.table([docs["id"], docs["doc"], docs["lang"], docs["key"], pa.array(chars), pa.array(total)], names=names)

    return run


def discounts(counts: DataFrame, n: str) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many grams occur once to four times."""
    seen = counts.agg(*[F.sum((F.col(n) == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (x or 0 for x in seen)
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def probabilities(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, p) for every distinct gram wanted, from (gram, n) of trusted text.

    The longest grams count as they occur, shorter ones by how many characters they follow. A gram
    gets its discounted share of its context and the context's freed mass times the probability of
    the gram without its first character; below single characters all are alike. Counts, contexts
    and wanted grams meet in joins on gram and context.
    """
    levels = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        longer = levels[size + 1]
        levels[size] = longer.groupBy(F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n"))
    letters = levels[1].count() + 1
    wanted = {ORDER: grams.select("gram").distinct()}
    for size in range(ORDER - 1, 0, -1):
        wanted[size] = wanted[size + 1].select(F.substring("gram", 2, size).alias("gram")).distinct()
    below = None
    for size in range(1, ORDER + 1):
        level = cut(levels[size]) if size < ORDER else levels[size]
        d = discounts(level, "n")
        context = F.substring("gram", 1, size - 1)
        of = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"), d)).alias("freed"))
        out = wanted[size].join(level, "gram", "left").withColumn("context", context).join(of, "context", "left")
        if below is None:
            out = out.withColumn("lower", F.lit(1.0 / letters))
        else:
            out = out.join(below.toDF("rest", "lower"), F.substring("gram", 2, size - 1) == F.col("rest"))
        n = F.coalesce("n", F.lit(0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((n - _discount(n, d) + F.col("freed") * F.col("lower")) / F.col("total"))
        below = cut(out.select("gram", p.alias("p")))
    return below


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, columns: tuple[str, str, str] = ("doc_id", "text", "lang")) -> DataFrame:
    """For each row of docs: doc_id, key (sha256 of the text), n_chars, perplexity (of a character),
    score (its logarithm), limit (of scores), keep.

    Trusted documents are those that labels (doc_id, quality) calls good. A model of character
    grams is learned from four fifths of them, by hash of the id; the others give each language the
    ``quantile`` of its perplexity, by mergeable sketches. A text is kept up to that limit. A language
    with fewer than FEW of these, and a null language, takes the limit of all.

    Documents are dealt to groups by id, so texts move once. A group sends its distinct grams, with
    counts over its trusted documents. Probabilities are joined on, gram by gram, and come back to
    the groups that asked. Counts cover all trusted text; no gram is left out.

    A null or empty text is never kept and has null perplexity. Rows alike are judged alike; a row
    without id is never trusted. Without held-back trusted text every text is kept. Empty tables
    give an empty result. Other columns are ignored.
    """
    doc_id, text, lang = columns
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, int(size / GROUP_BYTES))
    number = F.col(doc_id).cast("long")
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    dealt = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(number, F.lit(-(1 << 63))).alias("doc"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key"), deal(F.coalesce(number, F.xxhash64(text))).alias("g"),
    )
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc")).distinct()
    held = F.pmod(F.xxhash64("doc", F.lit("held back")), F.lit(5)) == 0
    by_group = dealt.mapInArrow(M.batches(B.deal_rows), "g bigint, part binary").groupBy("g")
    learned = trusted.filter(~held).withColumn("g", deal(F.col("doc")))
    counted = written(by_group.cogroup(learned.groupBy("g")).applyInArrow(M.cogroup(_count), "g bigint, gram string, n bigint"))
    counts = cut(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    cost = probabilities(counts.filter("n > 0"), counts).select("gram", (-F.log("p")).alias("cost"))
    asked = counted.select("g", "gram").join(cost, "gram")
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("id", "lang")}
    arrow = [to_arrow_type(dealt.schema[c].dataType) for c in ("id", "lang")]
    scored = by_group.cogroup(asked.groupBy("g")).applyInArrow(M.cogroup(_score(*arrow)), f"doc_id {kinds['id']}, doc bigint, lang {kinds['lang']}, key string, n_chars bigint, cost double")
    scored = cut(scored)

    known = scored.filter("n_chars > 0").join(trusted.filter(held), "doc")
    def limited(rows: DataFrame) -> DataFrame:
        return rows.agg(F.percentile_approx(F.col("cost") / F.col("n_chars"), quantile, 10000).alias("limit"), F.count("*").alias("held"))

    limits = limited(known.groupBy("lang")).filter((F.col("held") >= FEW) & F.col("lang").isNotNull())
    any_limit = limited(known.groupBy()).first()["limit"]
    out = scored.join(limits.select("lang", "limit"), "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(any_limit).cast("double")))
    score = F.when(F.col("n_chars") > 0, F.col("cost") / F.col("n_chars"))
    keep = (F.col("n_chars") > 0) & F.coalesce(score <= F.col("limit"), F.lit(True))
    return out.select("doc_id", "key", "n_chars", F.exp(score).alias("perplexity"), score.alias("score"), "limit", keep.alias("keep"))
