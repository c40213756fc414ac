"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataform.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.tiff import media_report

    return media_report(table(spark, sf_dir, "documents"))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.warc import revisit_records

    return revisit_records(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.quality import KEEP, held_out, score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.license_scan import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.conversation_repair import damage_report

    return damage_report(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataform.llm.spelling import DAMAGE, group_variants

    return group_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "op1_tiff_media": op1_tiff_media,
        "op2_warc_chunks": op2_warc_chunks,
        "op3_quality": op3_quality,
        "op4_packing": op4_packing,
        "op5_url_filter": op5_url_filter,
        "op6_decontamination": op6_decontamination,
        "op7_license_scan": op7_license_scan,
        "op8_language_id": op8_language_id,
        "op9_line_dedup": op9_line_dedup,
        "op10_near_dups": op10_near_dups,
        "op11_token_counts": op11_token_counts,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": pipeline,
    }
    return found


def oracle_sql() -> dict[str, str]:
    from strataform.llm import oracles

    return dict(oracles.SQL)
