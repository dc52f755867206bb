"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_text, table


def vocabulary() -> str:
    """The path of the packing vocabulary on this machine (the same on every worker)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import page_texts

    return page_texts(table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bloom_lm import score_texts, seventh

    scored = score_texts(table(spark, sf_dir, "documents"), ~seventh(F.col("doc_id")))
    return scored.select("doc_id", seventh(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import as_text, with_spans

    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_text(F.col("__base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("__all")).alias("spans"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_words

    return repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edit_fingerprints

    found = edit_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, predict

    docs = table(spark, sf_dir, "documents")
    held_out = crc_text(F.col("doc_id")) % 5 == 0
    model = fit(docs, ~held_out)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches

    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_documents
    from .vocabularies import path

    found = align_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    found = whitened(table(spark, sf_dir, "embeddings"), components=8)
    if found is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    each = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained")).alias("c")
    # beyond a long's range the exact decimal has no long
    return found.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", each).select("vec_id", F.col("c.component"), "n", "deviation", F.col("c.whitened"), F.col("c.explained"), "identity_error")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back
    from .vocabularies import path

    # one more conversation, whose texts hold what other templates use as control strings
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(format_conversations(turns, path("byte_bpe_50k.tiktoken")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_html_text, op3_lm_scoring, op4_simhash, op5_secrets, op6_substring_dedup, op7_order_minhash, op8_language_id, op9_sharding, op10_decontamination, op11_token_alignment, op12_whitening, op13_chat_format)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
