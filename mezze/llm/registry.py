"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from mezze.llm import bpe, chat, licenses, linedup, mixing, mpeg, near, oracles, pii, quality, tokens, trie, vectors, warc
from mezze.llm.common import saved, table, vocabulary
from mezze.session import shipped


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and the digest of what is left of all documents; see linedup.remove_boilerplate for nulls, ties and repeated rows."""
    out = linedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as silent audio, written, read back and indexed; a null text is an empty one, see mpeg.store_texts."""
    rows = mpeg.index_media(saved(mpeg.store_texts(table(spark, sf_dir, "documents")), "media"))
    seeks = F.sha1(F.array_join("seek_offsets", ","))
    feature = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("n_frames", "declared_frames", "n_samples", "sample_rate", "duration_us", "n_checked", "n_bad", "n_skipped")], F.concat(F.lit("seeks="), seeks))
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the contract's own, formatted and read back; null roles and texts are empty, see chat.records_of."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_formatted(chat.format_turns(chat.canonical_turns(chat.records_of(rows))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents; a null text has none, see bpe.encode."""
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents; see quality.judge for nulls and languages without a reference."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; a null text is an empty one, see tokens.count_tokens."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; a null html is an empty payload, see warc.archive_round_trip."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents; see near.near_duplicates for nulls and rows that share a doc_id."""
    return near.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=85)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all texts and their lines; see licenses.scan for nulls."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document; see mixing.mix for nulls, ties and repeated rows."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of the terms that disclose it in all documents; see pii.find for nulls and copies."""
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations after the contract's graft; see trie.sequences for nulls and ties."""
    rows = trie.sequences(table(spark, sf_dir, "conversations"))
    n_turns = F.crc32(F.col("conv_id").cast("string")) % 6
    return trie.trie(trie.grafted(rows, F.col("conv_id") - F.col("conv_id") % 100, n_turns, most=5))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors with the contract's parameters; see vectors.compress for nulls, ties and odd lengths."""
    return vectors.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_line_dedup, op2_mpeg_audio, op3_chat, op4_bpe, op5_divergence, op6_token_counts, op7_warc_revisits, op8_minhash, op9_licenses, op10_mix, op11_pii, op12_prefix_trie, op13_vector_codes)
    return {f.__name__: shipped(f) for f in operators} | {"pipeline": shipped(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": oracles.LINES, "op3_chat": oracles.CHAT, "op5_divergence": oracles.quality_sql(), "op7_warc_revisits": oracles.WARC,
        "op8_minhash": oracles.NEAR, "op9_licenses": oracles.licenses_sql(), "op12_prefix_trie": oracles.TRIE, "op13_vector_codes": oracles.vectors_sql(),
    }
