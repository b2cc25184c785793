"""The corpus pipeline: toxicity, line deduplication, near-duplicates, benchmark decontamination, sequence packing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's output to the shared folder and reads it again.

Defined results. Null, empty and white texts are never toxic and keep their lines; all texts without words are one group
of near copies, of which the one with the least id stays. Rows of equal id stay or go together; rows with a null id are
scored and cleaned, but are no copy of another and lose no line. Ties of near copies go to the least id. Very long texts
are whole in every stage. Empty tables give empty results. Columns keep their names and order, also where an operator
uses such a name itself; n_chars is counted anew where a stage changes texts. Null labels and null items are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, line_templates, packing, queries, simhash, toxicity
from keyloom.llm._shared import key_fold, table, written


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels of the held-out fold are never learnt from."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), key_fold(F.col("__id"), 5) != 0)
    return toxicity.score(docs, net).filter("toxicity_score < 0.5").select(*docs.columns)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in three or more documents (long ones: two) go, but for the first; so do documents of nothing else."""
    out = line_templates.dedup(docs)
    return _recounted(out.filter((F.col("n_dropped") == 0) | (F.trim("text") != "")).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts stays whose sets of five-word shingles have a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of ten or more words shared with a benchmark item are cut; mostly contaminated documents go."""
    return _recounted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_recurring_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # a trained network, a greedy tree and a tokenizer are beyond SQL; tests/llm/test_queries.py holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
