"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import abuse, conversations, mixing, neardup, packing, pii, split, survivor
from quern.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(table(spark, d, "memory_chunks"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "memory_chunks"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivor.choose_survivors(table(spark, d, "memories"), table(spark, d, "counts"), table(spark, d, "verdicts"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).select("group_id", "survivor_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(neardup.memory_texts(table(spark, d, "memories")), "memory_id", "text", n=3, least=0.5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).pairs().select(F.col("a").alias("memory_a"), F.col("b").alias("memory_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groups().withColumnRenamed("id", "memory_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.session_report(table(spark, d, "calls")).where("left_out").select("session")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(table(spark, d, "calls"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "entries"), table(spark, d, "memory_chunks"), table(spark, d, "name_parts"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    got = pii.redacted(pii.records_of(table(spark, d, "entries"), table(spark, d, "memory_chunks")), table(spark, d, "name_parts"))
    return got.select("src", "row_id", "clean", "redacted")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d))


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """The fill with limits on segments and loss that bind: a segment for 192 tokens, and loss-bearing tokens for nine tenths."""
    return packing.fill_report(packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_sizes"), loss_share=0.9, tokens_per_segment=192))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).selection()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


def p7_budget_report(spark: SparkSession, d: str) -> DataFrame:
    """A mix of as many tokens as the sources have: the exponent is bisected to the repetition limits."""
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), budget=1.0).report()


def p7_entropy_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares flattened to nine tenths of the entropy of equal shares, in a mix of at least half of all tokens."""
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), entropy=0.9, least_mix=0.5).report()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return abuse.score_documents(documents, abuse.fit(documents, table(spark, d, "doc_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
