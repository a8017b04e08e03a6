"""A corpus pipeline: five stages, each one operator, each written and read again.

Every stage takes documents as they are: a null in any column, empty and very long texts, repeated rows
and ids, empty tables and further columns of any names, helper names of the operators included. What
each stage does with them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import decontaminate, language_id, line_dedup, mixing, near_copies
from assaykit.llm.common import scratch, spare, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter (null and empty texts too) or unlike
    every language go. A null lang or doc_id is nothing to learn from, and such rows are judged like
    others. Equal rows share their fate. Of languages that are equally likely the first by name wins.
    Without any row to learn from no language can be found, and no row stays."""
    return language_id.keep_identified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the runs of lines, and the passages of 50 words on one or two lines, that an earlier
    document or line has; a document of which nothing but a copy was there goes. n_chars is that of
    the new text. Documents are in the order of doc_id, null first; a null or empty text has no such
    line and stays as it is; rows equal in doc_id and text are one document and lose the same lines."""
    removed = spare(docs.columns, "__n_lines", "__n_removed_lines", "__n_runs")
    out = line_dedup.dedup_lines(docs, pairs=True, added=tuple(removed))
    out = out.where((F.col(removed[1]) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id, then hash of the text. Near
    copies share 0.8 of their 5-word shingles (Jaccard), by exact check of what SimHash links by op8's tries and of
    MinHash's candidates beyond its budget. Rows are told apart by themselves, not by doc_id: a row without an id stays if it is no copy
    (null comes last), of equal rows one stays, and different texts of one id both stay. Texts without a
    word are copies of each other."""
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget, row by row; a null or empty text
    holds none and stays."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which each is taken; those of rate 0 go, as all do that are likelier
    toxic than anything else. A null or empty text has the prior's posteriors and stays. Labels are
    joined to the classifier's rows by doc_id; every row, with an id or without, is judged by its text.
    A column of documents that has the name of an added one keeps it; the added one gets underscores."""
    labels = mixing.quality_labels(table(spark, sf_dir, "labels"))
    out = mixing.mix(docs, labels, keep=docs.columns)
    *_, rate, residual = out.columns
    return out.where(F.col(rate) > 0).drop(residual)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mixing", mix_to_weights),
]

#: SQL has no Kneser-Ney training, MinHash of shingles or gradient steps; tests compare each stage
#: with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what one returns is written and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
