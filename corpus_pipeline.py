"""A corpus pipeline: five stages over documents, each an operator of creditloom.llm, each written before the next reads it."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import bytesops, langid, linedup, neardup, packing, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.7
#: What is left of a text that lost more than half of its bytes must have so many words to stay.
SCRAP_WORDS = 50
_runs = itertools.count()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM. Labels are learned from the rows that op7 learns from.

    Null and empty texts score as the model's bias alone and stay unless that is toxic; null ids are scored like others and
    train nothing; rows that repeat an id are judged each by its own text. No documents give none; without labels all stay.
    Very long texts are scored whole. Other columns than those of documents are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.expr(bytesops.id_mod("doc_id", 3)) != 1)
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    carried = [F.col(c) for c in COLUMNS if c != "doc_id"]
    return toxicity.score(docs, model, "doc_id", "text", *carried).where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows.

    Null texts and texts without a letter go, and so do those to which the likeliest language gives a lower probability
    than blind chance. Where no language could be learned, as without a label, all stay. Ids play no part in it, so
    repeated rows are judged alike. Very long texts are read whole. No documents give none. Other columns are left out.
    """
    held = F.coalesce(F.expr(bytesops.id_mod("doc_id", 4)) == 2, F.lit(False))
    model = langid.fit(docs.where(~held), "doc_id", "text", "lang")
    if not model[0]:
        return docs.select(*COLUMNS)
    carried = [F.col(c) for c in COLUMNS if c != "doc_id"]
    known = (F.col("lang_pred") != "und") & (F.col("fit") > langid.UNFIT)
    return langid.predict(docs, model, "doc_id", "text", *carried).where(known).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of passages of 50 words or more, whole lines or not; n_chars follows the text.

    Documents left without a word go, and so do scraps: a text that lost more than half of its bytes and has fewer than
    SCRAP_WORDS words left. Null and empty texts stay as they are, null ids come first in order, and rows alike in id and
    text share their deletions. Very long texts are rewritten in time linear in their length. No documents give none.
    """
    left = linedup.drop_repeated_lines(docs.select(*COLUMNS, F.octet_length("text").alias("__bytes")), inline_words=linedup.MIN_WORDS)
    changed = F.coalesce(F.octet_length("text") != F.col("__bytes"), F.lit(False))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    scrap = (words == 0) | ((2 * F.octet_length("text") < F.col("__bytes")) & (words < SCRAP_WORDS))
    left = left.where(~changed | ~scrap)
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    A row without an id takes one from its text, above all others, so it stays only where no document with an id is in its
    group. Of rows alike in id and text one stays. Texts without words, null ones too, are groups of their own id. Very
    long texts are compared by all their shingles. No documents give none. Other columns are left out.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit((1 << 62) - 1)))
    docs = docs.select(*COLUMNS).withColumns({"__id": own, "__name": F.xxhash64("doc_id", "text")})
    groups = neardup.near_duplicates(docs, k=5, percent=80, id_col="__id")
    kept = groups.where("kept").select(F.col("id").alias("__id")).distinct()
    left = docs.join(kept, "__id", "left_semi")
    again = bytesops.cut_lineage(docs.groupBy("__name").agg(F.count("*").alias("n")).where("n > 1").select("__name"))
    if not again.isEmpty():
        alike = left.join(again, "__name", "left_semi").dropDuplicates(["__id", "__name"])
        left = left.join(again, "__name", "left_anti").unionByName(alike)
    return left.select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, as op4 returns them.

    A null text has the end id alone; null and repeated ids are packed like others; no documents give no pieces. Very long
    texts are cut into pieces of 4096 ids. Other columns are left out.
    """
    pieces = packing.token_pieces(docs, packing.word_tokenizer()).drop("ids")
    return packing.pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_documents),
]
#: No SQL: trained classifiers and a tokenizer stand in the way. tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again by the next, then removed."""
    root = f"{bytesops.shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{next(_runs)}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(now := f"{root}/{k}-{name}")
        docs = spark.read.parquet(now)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = now
    return docs
