"""A corpus pipeline over documents: each stage calls one operator of vitreon.llm.

Stages keep the columns of documents up to the last, which turns what is left into token ids. run() writes every
stage's result to the shared scratch folder and reads it again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitreon.llm import bpe, linededup, mixing, ngramjoin, toxicity
from vitreon.llm.common import Scratch, roots, sweep, table


def _sized(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in df.columns else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among these, doesn't call toxic."""
    return toxicity.clean(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that stand elsewhere already."""
    return _sized(linededup.dedup(docs).select(*docs.columns))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of five-word shingles with similarity 0.8 join: that of the lowest doc_id, then text.

    Rows are told apart by doc_id and text, so rows of one doc_id with unlike texts are documents of their own. Documents
    without words are in no group, nor are those without doc_id; all of them stay.
    """
    scratch = Scratch(spark, "groups")
    row = F.xxhash64("doc_id", "text")
    known = docs.where("doc_id is not null")
    joined = ngramjoin.join(known.select(row.alias("doc_id"), "text")).where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = known.select(row.alias("_row"), "doc_id", "text").join(joined.hint("merge"), "_row")
    lowest = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", F.sha2("text", 256).alias("sha"), "_row")).alias("m")).select("m._row")
    # rows in groups that aren't the one to stay; of equal rows, all but the first
    fate = scratch.keep(joined.join(lowest.withColumn("_stays", F.lit(True)), "_row", "left").select("_row", F.coalesce("_stays", F.lit(False)).alias("_stays")), "fate")
    # a row without doc_id has a key of its own, so that such rows are spread
    key = F.when(F.col("doc_id").isNotNull(), row).otherwise(F.xxhash64(F.monotonically_increasing_id(), F.lit("row")))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").isNotNull().alias("_known"), key.alias("_key"))
    met = packed.join(fate.hint("merge"), F.col("_key") == F.col("_row"), "left").withColumn("_grouped", F.col("_known") & F.col("_row").isNotNull())
    met = met.withColumn("_first", F.row_number().over(W.partitionBy("_key").orderBy("_known")))
    return met.where(~F.col("_grouped") | F.col("_stays") & (F.col("_first") == 1)).select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.copies(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, and decoded_sha256 of the bytes that the ids decode to."""
    return bpe.encode(docs, *bpe.tokenizer(), decoded=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: A trained classifier and entropy balancing are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table documents."""
    others = roots()
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{i}")
            scratch.drop(before)
            sweep(others | {scratch.root})
    return docs
