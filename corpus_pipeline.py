"""From raw documents to tokens: five stages, each a table that the next one reads.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept;
all but the last return the columns of documents.

In every stage a null or empty text is a document like others, a null doc_id is no key and
links its row to nothing, rows that repeat a doc_id count as one document, an empty
table stays empty, and columns of any name pass through to the stage before the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterism.llm._spark import written
from asterism.llm.decontam import drop_contaminated
from asterism.llm.lines import dedup_lines
from asterism.llm.neardup import near_duplicates
from asterism.llm.pieces import encode_documents
from asterism.llm.registry import table
from asterism.llm.toxicity import drop_toxic

#: No SQL: the first, third and last stage can't be expressed in it; tests hold each stage against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go.

    Null and empty texts score as the labelled texts without marks do and stay; repeated rows stay or go together.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; every document stays, n_chars is counted again.

    A null text stays null (n_chars null).  Rows with a null doc_id keep their texts, and so do rows that repeat a doc_id among themselves.
    """
    out = dedup_lines(docs).drop("n_lines", "n_lines_removed")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays.

    Texts without words and rows with a null doc_id are copies of nothing and stay; all rows of a doc_id stay or go together.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    # always by merge: what goes grows with the documents
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also a re-parameterised one, go.

    Null and empty texts hold none and stay, as do all documents where the benchmark is empty; a row with a null doc_id goes like others.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding gives its text again.

    Null and empty texts have no tokens; one row for each row of docs, a null doc_id stays null.
    """
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
