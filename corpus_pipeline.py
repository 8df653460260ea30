"""The corpus pipeline: documents that the quality rules keep, without frequent lines, one of each group of near
copies, without benchmark passages, as token ids.

Every stage takes the documents that the stage before kept, and returns the columns of ``documents`` (the last
one returns the tokens' digests). ``n_chars`` follows the text. An empty table passes through every stage as
an empty one; texts are read whole, however long; columns beyond those of ``documents``, whatever their names, are
carried to the stage before the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import encode_texts
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.jaccard_join import drop_near_copies
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.quality_rules import apply_quality_rules
from millrace.llm.queries import digest_ids, table, trusted, vocabulary_path
from millrace.llm.staging import Stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like the trusted ones.

    Null, empty and blank texts have too few words and go; a document with a null id or a repeated one is judged
    by its text like any other, and counts as trusted by its id.
    """
    return apply_quality_rules(docs, trusted(spark, sf_dir)).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in ten documents or more.

    Every row stays, if need be with an empty text; null texts become empty ones.
    """
    return dedup_lines(docs, min_docs=10).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the least id.

    Of repeated rows one stays, null ids come after all others, and rows without a word all stay.
    """
    return drop_near_copies(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Rows with null or empty texts stay, and so do all where there are no items; repeated rows are judged each.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the text decoded from them, a row for each row; null texts are empty ones."""
    return digest_ids(encode_texts(docs.select("doc_id", "text"), vocabulary_path("byte_bpe_50k.json"), decoded="decoded"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: The log-likelihood ratio, the substitution-tolerant overlaps and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = stage.write(step(spark, docs, sf_dir), f"{k}_{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
