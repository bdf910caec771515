"""A corpus pipeline: language identification, near-duplicate removal, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on every document that its predecessor kept; all but the last return the
columns of ``docs``. The driver writes a stage's result as Parquet and reads it again for the next one; ``run`` does the
same in the shared folder.

* language: learns from the labelled documents; a document whose text is null or has no letter is rejected. A predicted
  language replaces a missing label; if no document is labelled, labels stay missing.
* near_duplicates: documents link at a Jaccard similarity of 0.8 of their five-word shingles; of each group of linked
  documents the one with the smallest id stays. Documents without words, or without an id, stay; rows that share an id and
  a text stay or go together, rows that share an id alone are judged each by its text.
* decontamination: documents with a window that reaches similarity 0.8 with a benchmark item go, those without an id too; of
  rows that share an id only those whose own text has such a window.
* personal_data: every span found is replaced by its kind in angle brackets; ``n_chars`` follows the text.
* packing: the documents' ids in sequences of at most 1024.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import decontaminate, jaccard, packing, personal
from callweave.llm import language as language_id
from callweave.llm.common import delete_path, fresh_path, scratch
from callweave.llm.queries import table, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = next(x for n in count() if (x := f"lang_pred_{n}") not in docs.columns)
    sure = next(x for n in count() if (x := f"lang_score_{n}") not in docs.columns)
    judged = language_id.predict(docs, model, names=(found, sure))
    kept = judged.where(F.col(found) != "und").withColumn("lang", F.coalesce("lang", found))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = jaccard.grouped(docs, k=5, num=80, den=100).where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id"), F.col("text_hash").alias("copy_hash")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("copy_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("copy_hash"))
    return docs.join(copies, same, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaked = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaked_id"), F.col("text_hash").alias("leaked_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("leaked_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("leaked_hash"))
    return docs.join(leaked, same, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Kernels, sketches and tokenizers are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):  # a stage's own tables go once its result is written
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
