"""The thin queries over the test tables: each applies one operator to its whole table.

They derive the agreed digest columns from the operators' real outputs (texts, ids, spans).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.bpe import encode_texts
from millrace.llm.chat_format import format_chats, read_chats
from millrace.llm.decontaminate import find_overlaps
from millrace.llm.html_extract import extract_main_text
from millrace.llm.jaccard_join import jaccard_components
from millrace.llm.line_dedup import dedup_lines
from millrace.llm.periodic import find_runs, repeat_tail
from millrace.llm.pii import find_pii
from millrace.llm.quality_classifier import sample_labels, score, train
from millrace.llm.quality_rules import apply_quality_rules
from millrace.llm.spelling import count_words, group_spellings
from millrace.llm.token_counts import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents that every label of theirs calls good."""
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, vocabulary_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = apply_quality_rules(docs, trusted(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    chats = format_chats(turns.unionByName(extra))
    read = read_chats(chats.select("conv_id", "formatted", "mask", F.char_length("formatted").cast("long").alias("formatted_chars")), keep=("formatted_chars",))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1):
    """The fold that training must not see."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    # a bounded sample of labels (6,000), so the text side needs no shuffle
    weights = train(docs.join(F.broadcast(sample_labels(labels)), "doc_id"))
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_ids(encode_texts(docs, vocabulary_path("byte_bpe_50k.json"), decoded="decoded"))


def digest_ids(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(count_words(table(spark, sf_dir, "documents")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=repeat_tail)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(folds=5, fold=0)
    labels = table(spark, sf_dir, "labels").where(~fold).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs.join(F.broadcast(sample_labels(labels)), "doc_id"))
    return toxicity.score(docs, model).select("doc_id", fold.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts,
        op2_quality_rules,
        op3_chat_format,
        op4_quality_classifier,
        op5_bpe,
        op6_ngram_jaccard,
        op7_pii,
        op8_decontamination,
        op9_html,
        op10_line_dedup,
        op11_spelling,
        op12_periodic,
        op13_toxicity,
    )
    return {f.__name__: f for f in found}
