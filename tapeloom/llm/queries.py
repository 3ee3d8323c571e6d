"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import alignment, chat, decontam, mixing, neardup, packing, quality, secrets, substring, tokenfile, tokens, urls, warc, whitening
from tapeloom.llm.registry import query, table


@query("op7_best_fit_packing")
def best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), tokens.find(tokens.WORD_BPE), 2048)


@query("op10_repair_token_files")
def repair_token_files(spark: SparkSession, root: str) -> DataFrame:
    files = tokenfile.write(table(spark, root, "documents"), tokens.find(tokens.BYTE_BPE), 50_257)
    return tokenfile.read(files)


@query("op5_benchmark_decontamination", decontam.SQL)
def benchmark_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = decontam.find(table(spark, root, "documents"), table(spark, root, "benchmark"), 10, columns=["doc_id"])
    return decontam.report(found)


@query("op6_url_vocabulary", urls.SQL)
def url_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge(table(spark, root, "pages"))


@query("op8_risk_controlled_rules")
def risk_controlled_rules(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.judge(table(spark, root, "documents"), table(spark, root, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *base)


@query("op4_recursive_secret_scan")
def recursive_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return secrets.find(table(spark, root, "documents"), "doc_id")


@query("op1_perspective_rotation", chat.SQL)
def perspective_rotation(spark: SparkSession, root: str) -> DataFrame:
    return chat.flat_mask(chat.rotate(table(spark, root, "conversations")))


@query("op2_warc_chunk_table")
def warc_chunk_table(spark: SparkSession, root: str) -> DataFrame:
    archives = warc.write(table(spark, root, "pages"))
    return warc.digests(warc.read(archives, with_data=False))


@query("op9_doubling_windows", substring.SQL)
def doubling_windows(spark: SparkSession, root: str) -> DataFrame:
    return substring.remove(table(spark, root, "documents"), 13, 7)


@query("op3_minhash_coordinate_join", neardup.SQL)
def minhash_coordinate_join(spark: SparkSession, root: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, root, "documents"), 4, 80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op11_block_matrix_whitening")
def block_matrix_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"), 32)


@query("op12_byte_end_alignment")
def byte_end_alignment(spark: SparkSession, root: str) -> DataFrame:
    return alignment.compare(table(spark, root, "documents"), tokens.find(tokens.BYTE_BPE), tokens.find(alignment.PIECE_BPE))


@query("op13_context_mixing_score")
def context_mixing_score(spark: SparkSession, root: str) -> DataFrame:
    return mixing.score(table(spark, root, "documents"))
