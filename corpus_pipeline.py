"""A training corpus from documents: quality, line dedup, near duplicates, decontamination, mixing.

Stages take documents with the columns doc_id, text, lang and source, and any others, which go
through unchanged whatever their names; columns that a stage makes for itself get names that docs
has not. All but the last return the columns of docs. Every stage gives an empty table for an empty
one, reads whole texts however long, and decides rows by id and text: rows alike in both stay or go
together (in mix they are documents by themselves, like any others).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm._tables import cut, earlier_sums, in_ranges, shared_folder, small_or_shuffled, table
from lanewise.llm.decontamination import decontaminate
from lanewise.llm.jaccard_join import jaccard_components
from lanewise.llm.line_dedup import dedup_lines
from lanewise.llm.mixing import BUCKET_ROWS, mix_sources
from lanewise.llm.quality import classify

#: SQL cannot express the first two stages.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _text_key() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text key are rejected (r_id, r_key)."""
    key = _free(docs, "text_key")
    rejected = small_or_shuffled(rejected.toDF("r_id", "r_key").distinct())
    keyed = docs.withColumn(key, _text_key())
    return keyed.join(rejected, keyed["doc_id"].eqNullSafe(rejected["r_id"]) & (keyed[key] == rejected["r_key"]), "left_anti").drop(key)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each id and text in the column ``name``: the id; for rows without id,
    and for all texts of an id but the first by hash, numbers after the largest id."""
    rows = docs.select("doc_id", _text_key().alias("key"))
    texts = rows.groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    several = small_or_shuffled(texts.filter("doc_id is null or first <> last").select(F.col("doc_id").alias("s_id"), "first"))
    if not several.take(1):
        return docs.withColumn(name, F.col("doc_id"))
    more = rows.join(several, F.col("doc_id").eqNullSafe(F.col("s_id"))).filter("doc_id is null or key <> first").select("doc_id", "key").distinct()
    more = cut(more.withColumn("one", F.lit(1)))
    highest = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    more = in_ranges(more, more.count() // BUCKET_ROWS, ["doc_id", "key"], "range")
    place = F.row_number().over(Window.partitionBy("range").orderBy("doc_id", "key"))
    more = more.withColumn("place", place).join(earlier_sums(more, "range", "one", "ahead"), "range")
    more = small_or_shuffled(more.select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), (F.lit(highest) + F.col("ahead") + F.col("place")).alias("number")))
    of = docs.join(more, docs["doc_id"].eqNullSafe(more["m_id"]) & (_text_key() == more["m_key"]), "left")
    return of.select(*[docs[c] for c in docs.columns], F.coalesce(more["number"], docs["doc_id"]).alias(name))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: those whose perplexity is not above the limit of
    their language.

    Null and empty texts go. A row without id is judged by its text; one without language by the
    limit of all languages. Rows alike in id and text are judged alike. Ties at the limit stay.
    Without labels every text stays.
    """
    judged = classify(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.filter(~F.col("keep")).select("doc_id", "key"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, or nearly; those of which nothing is left go.

    Null texts, and texts that lose no line, stay as they are. Rows alike in id and text are one
    document. Rows without id come after all others; of these, and of rows that share an id, each
    text is a document of its own, ordered by its hash. n_chars, if docs has it, follows the text.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = dedup_lines(docs, carry=others)
    changed = F.size(F.coalesce("dropped", F.array().cast("array<bigint>"))) > 0
    out = out.filter(~changed | (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != ""))
    of = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest")[c] for c in docs.columns}
    if "n_chars" in of:
        of["n_chars"] = F.when(changed, F.length("text")).otherwise(of["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[of[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest id: texts that share 80
    hundredths of their 5-word shingles are linked, and links make groups.

    Null and blank texts have no shingles and stay. A row without id is a document by its text, after
    all rows with ids; of rows that share an id, each different text is a document, the first by
    hash under the id and the others after all ids.
    """
    number = _free(docs, "number")
    numbered = _numbered(docs, number)
    groups = jaccard_components(numbered, gram=5, percent=80, columns=(number, "text"))
    copies = groups.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id")))
    copies = small_or_shuffled(copies.select(F.col("doc_id").alias("copy")).distinct())
    return numbered.join(copies, numbered[number] == copies["copy"], "left_anti").drop(number)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and wordless texts hold none and stay; so does every text if there are no items. Rows
    without id are judged by their text.
    """
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)
    return _without(docs, judged.filter("contaminated").select("doc_id", "key"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, one row for each row of docs, with size, source_size,
    target of the source, taken (words, repeats counted) and first_finish.

    Null and blank texts give no words and go. Rows alike are documents by themselves, each with its
    own share; null ids and null sources queue like others. Columns of docs that have one of the
    five names give way to these.
    """
    made = ("size", "source_size", "target", "taken", "first_finish")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    whole = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    row = _free(docs, "alike")
    # rows alike in all columns are the same to any reader, so each may have the share of any of them
    keyed = docs.withColumn(row, F.struct(F.xxhash64(*whole), F.xxhash64(F.lit("again"), *whole)))
    mixed = mix_sources(keyed, carry=(row,)).filter("taken > 0").select(F.col("rest")[row].alias("m_row"), *made)
    texts = keyed.repartition(row).dropDuplicates([row])
    return texts.join(mixed, texts[row] == mixed["m_row"]).drop(row, "m_row")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("clean_of_benchmark", clean_of_benchmark),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder, where it stays
    until the application ends, and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    for place, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if place == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{place}-{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        docs = spark.read.parquet(f"{folder}/{place}-{name}")
    return docs
