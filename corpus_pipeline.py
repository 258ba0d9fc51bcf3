"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what the one before kept, as written Parquet; all but the last return the columns of documents.

Defined results of all stages: an empty table gives an empty table; extra columns, of any names, pass through all stages but the last, which reads
doc_id and text only; a null doc_id is a document like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import mixing, nearcopies, packing, quality, substring
from loomspark.llm.common import materialise
from loomspark.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that fail; rejects documents that fail the base rules or lose over half of their text that way.

    Null and empty texts are rejected, as they have under ten words; repeated rows are judged alike; a document of exactly half its text stays.
    """
    return quality.keep_cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) the document with the smallest doc_id stays.

    Operator 1 at a similarity its 64 bits can't hold: see ``llm/nearcopies.py``. Null and blank texts are copies of each other; of repeated rows, and of
    rows with one doc_id and text, one stays; null doc_ids come after all others, ties go by text hash.
    """
    return nearcopies.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out bytes of 200-byte strings that occur twice or more; documents stay, with what is left of their text.

    Null texts stay null; repeated rows empty each other; a character that is cut in two goes as a whole.
    """
    return substring.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts or leaves out documents until each source has its target of words; the table's rows are in the order of the mix.

    Texts without words (null ones too) are never taken; a null source is a source; equal rows are interchangeable, and reruns agree.
    """
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of at most 2048 tokens.

    A null text holds just the end id; each row of the mix is packed on its own, so a document taken twice is packed twice.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packed_sequences", packed_sequences)]
#: SQL can express neither XXH64 fingerprints nor the tokenizer: tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
