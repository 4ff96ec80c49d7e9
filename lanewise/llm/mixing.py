"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm._tables import cut, earlier_sums, in_ranges, small_or_shuffled

#: Rows that a range holds on average; a range is the unit of a task.
BUCKET_ROWS = 20_000
#: Packets that the mix has at least, if all its documents are long: a document longer than this share of the mix queues in parts.
PACKETS = 100_000
SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: tuple[int, int], epochs: int) -> DataFrame:
    """Targets of sources from (source, source_size): shares of the budget by weight, none above
    ``epochs`` times its source's size, the excess reshared by weight.

    Sources by code point, nulls last, take the weights in turn. With sources in the order of
    size / weight, those at their limit come first; sums up to each source tell whether it is one.
    The windows without a key run over one row for each source, never over documents.
    """
    whole, part = budget
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    filling = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(every)
    ranked = ranked.select(
        "*",
        total.alias("total"),
        F.coalesce(F.sum("source_size").over(filling), F.lit(0)).alias("full"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), F.lit(0))).alias("open"),
    )
    # limit <= (budget - limits before) * weight / open weights; doubles, as products may pass 2 ** 63
    left = (whole * F.col("total") - epochs * part * F.col("full")).cast("double")
    at_limit = (epochs * part * F.col("source_size")).cast("double") * F.col("open") <= left * F.col("weight")
    ranked = ranked.withColumn("at_limit", at_limit)
    ranked = ranked.select(
        "source", "source_size", "rank", "weight", "total", "at_limit",
        F.coalesce(F.sum(F.when(F.col("at_limit"), F.col("source_size"))).over(every), F.lit(0)).alias("filled"),
        F.sum(F.when(~F.col("at_limit"), F.col("weight"))).over(every).alias("sharing"),
    )
    left = (whole * F.col("total") - epochs * part * F.col("filled")).cast("double")
    share = left * F.col("weight") / (part * F.col("sharing")).cast("double")
    return ranked.select("source", "source_size", "rank", "weight", F.when(F.col("at_limit"), (epochs * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget: tuple[int, int] = (3, 2),
    epochs: int = 2,
    seed: str = "",
    columns: tuple[str, str, str] = ("doc_id", "text", "source"),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Draws a mix of ``budget`` (a fraction of all words) by weighted fair queueing over the sources.

    Each source queues its documents in the order of a hash of their ids, up to ``epochs`` times
    over. A document's virtual finish time is the words of its source that are queued up to its
    end over the source's weight. All sources' queues are sorted together by finish time, in ranges
    by sampled cut points, and cut where the words before reach the budget: so a source gets words
    in proportion to its weight until its queue ends, and the others share what it leaves. A
    document of more than a PACKETS-th of the mix queues in packets of that size, as long messages
    do in networks, so no source is ahead of its share by more than a packet, and the last packet
    is taken in part. The target (see targets) only tells what comes of that; nothing is cut at it.

    Running sums go by ranges of the hash and of the finish time, each of about BUCKET_ROWS rows
    however large a source is; rows of one id, or of none, are dealt over ranges like any others.

    Returns doc_id, size, source_size, target, taken, source, first_finish (virtual time at which
    its first packet is through; null if none is taken) and the columns ``carry`` in a struct named
    rest (null without any), one row for each row of docs.

    Null or blank text: size 0, taken 0. Null ids queue by the hash of no characters, null sources
    are one source, after all others. Rows alike in every column are separate documents; so are
    rows that share an id, which queue by size and by a hash of the text. An empty table gives an
    empty result. Other columns are ignored.
    """
    id_col, text_col, source_col = columns
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("hash"),
        F.xxhash64(text_col).alias("twist"),
        F.monotonically_increasing_id().alias("row"),
        (F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")).alias("rest"),
    )
    sized = cut(sized)
    total_rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    limit = total * budget[0] // budget[1]
    packet = max(1, limit // PACKETS)
    sources = small_or_shuffled(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, epochs))
    known = sources.select(F.col("source").alias("s_source"), "source_size", "rank", "weight", "target")

    # rows alike in all of this but the last are interchangeable
    order = ["hash", "doc_id", "size", "twist", "row"]
    filled = sized.filter("size > 0").join(known, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    filled = in_ranges(filled, total_rows // BUCKET_ROWS, ["rank", *order], "bucket")
    within = Window.partitionBy("rank", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    queued = filled.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(earlier_sums(filled, "bucket", "size", "earlier", ("rank",)), ["rank", "bucket"])
    queued = queued.select("doc_id", "source", "size", "source_size", "rank", "weight", "target", "rest", (F.col("earlier") + F.col("inside")).alias("first_start"))

    copies = queued.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    copies = copies.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(packet).cast("long"))))
    copies = copies.withColumn("start", F.col("first_start") + F.col("epoch") * F.col("source_size") + F.col("at"))
    copies = copies.withColumn("words", F.least(F.lit(packet), F.col("size") - F.col("at"))).drop("epoch", "at")
    copies = copies.withColumn("finish", (F.col("start") + F.col("words")) / F.col("weight"))
    order = ["finish", "rank", "start"]
    copies = in_ranges(copies, epochs * (total_rows + total // packet) // BUCKET_ROWS, order, "range")
    in_range = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("inside", F.coalesce(F.sum("words").over(in_range), F.lit(0))).join(earlier_sums(copies, "range", "words", "ahead"), "range")
    copies = copies.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), F.lit(limit) - F.col("ahead") - F.col("inside"))))

    mixed = copies.groupBy("rank", "first_start").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target", "rest")],
        F.sum("taken").alias("taken"), F.min(F.when(F.col("taken") > 0, F.col("finish"))).alias("first_finish"),
    )
    blank = sized.filter("size = 0").join(known, F.col("source").eqNullSafe(F.col("s_source")))
    out = ("doc_id", "size", "source_size", "target", "taken", "source", "first_finish", "rest")
    blank = blank.withColumns({"taken": F.lit(0).cast("long"), "first_finish": F.lit(None).cast("double")})
    return mixed.select(*out).unionByName(blank.select(*out))
