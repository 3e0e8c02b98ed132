"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, which may have any other columns. Rows that repeat a doc_id and its text are one document,
of which near dedup keeps one. Tables without rows pass every stage as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantavol.llm import mixing, neardup, packing, phrases, quality
from quantavol.llm._common import Stage, fresh, n_words
from quantavol.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from `labels`, unchanged.

    Null, empty and very short texts fail the base rules. Rows that repeat are judged each.
    """
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group linked by a similarity of 0.8 or more.

    Of rows with equal doc_id and text one stays, the first by its other columns; rows without a
    doc_id all stay, as do texts without a word.
    """
    stage = Stage(spark, "near-dedup")
    key, kept_, rows_, at_ = fresh(docs, "key", "kept", "rows", "at")
    ids = neardup.near_duplicates(spark, docs, 80).filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(key))
    marked = stage.table(ids.agg(F.min("kept").alias(kept_), F.count(F.lit(1)).alias(rows_)).filter(~F.col(kept_) | (F.col(rows_) > 1)), "marked", "snappy")
    repeated = marked.filter(kept_)
    rows = docs.join(marked, F.col("doc_id") == F.col(key), "left_anti")
    if repeated.isEmpty():
        return rows
    others = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name not in ("doc_id", "text")]
    w = Window.partitionBy("doc_id", "text").orderBy(*(others or ["doc_id"]))
    one = docs.join(repeated, F.col("doc_id") == F.col(key), "left_semi").withColumn(at_, F.row_number().over(w)).filter(F.col(at_) == 1).drop(at_)
    return rows.unionAll(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words or more that stand earlier; those left without a word go.

    n_chars, where docs have it, is that of the new text. Null texts go as they have no word.
    """
    prefix = "new_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    kept = phrases.remove_repeats(spark, docs, 20, carry=tuple(c for c in docs.columns if c != "text"), prefix=prefix)
    kept = kept.filter(F.col(f"{prefix}n_words") > F.col(f"{prefix}n_removed"))
    text = F.col(f"{prefix}kept_text")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return kept.select(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 5, 2, 1 in turn, a document at most 3 times.

    Documents without a source are the last source; texts without a word are never taken.
    """
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    mixed = mixing.mix(spark, docs, n_words(F.col("text")), F.array("source"), prefix=prefix)
    copies = F.col(f"{prefix}copies")
    again = mixed.filter(copies > 0).withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens; rows that repeat are packed each."""
    return packing.pack_documents(spark, docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

#: Learned rules, removal by the order of ids and packing have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage needed goes when it is written."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        made = len(Stage.made)
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage.table(docs, f"stage-{i}")
            Stage.release(made)
            if i:
                stage.drop(f"stage-{i - 1}")
    return docs
