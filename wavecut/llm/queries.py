"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecut.llm import html_extract, oracles
from wavecut.llm.chat import default_ranks, format_and_read_back
from wavecut.llm.common import ship_path
from wavecut.llm.compact_windows import repeated_passages
from wavecut.llm.conversations import damaged, reports, with_edits
from wavecut.llm.divergence import source_divergence
from wavecut.llm.encode import default_tokenizer
from wavecut.llm.langid import default_vocabulary, identify
from wavecut.llm.minhash import near_copies
from wavecut.llm.packing import pack_mixture
from wavecut.llm.rabitq import nearest
from wavecut.llm.sharding import shard_records
from wavecut.llm.simhash import as_hex, near_duplicates
from wavecut.llm.templates import contaminated
from wavecut.llm.token_index import token_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"), default_tokenizer())


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_mixture(table(spark, sf_dir, "documents"), default_tokenizer())


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_records(table(spark, sf_dir, "documents"), shards=24, grown=25)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


def op8_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: A conversation whose texts hold the control strings of the template.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return format_and_read_back(turns.unionByName(control), default_ranks())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), default_vocabulary())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return reports(turns, with_edits(damaged(turns)))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_index": op2_token_index,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_rendezvous_sharding": op5_rendezvous_sharding,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_simhash": op7_simhash,
    "op8_one_bit_codes": op8_one_bit_codes,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_minhash": op12_minhash,
    "op13_source_divergence": op13_source_divergence,
}
# The others have none: tokenizers, XXH64, fitted models and hashed windows have no counterpart in DuckDB's SQL.
ORACLES: dict[str, str] = {
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op12_minhash": oracles.NEAR_COPIES,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
