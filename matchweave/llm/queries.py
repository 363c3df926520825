"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchweave.llm import best_fit, bpe_fst, chat, embed_dedup, minhash, packing, prefix_trie, quality, substring, target_encoding, token_count, toxicity, url_filter
from matchweave.llm.oracles import oracle_sql
from matchweave.llm.shared import Workspace, bounded_batches
from matchweave.llm.shared import table as stored

__all__ = ["oracle_sql", "queries"]

#: Fixed values of the contract: (verdict, host, path prefix).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Fixed values of the contract: the extra conversation.
EXTRA_TURNS = "SELECT -1L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stored(bounded_batches(spark), sf_dir, name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block list of hosts: those with at least one url that carries a tracking mark, wherever no rule fits."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.tracking_hosts(pages), Workspace(spark, "op1"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), Workspace(spark, "op3"), threshold=0.98)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), Workspace(spark, "op4"), size=35)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op5"), n=2, percent=80)


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(EXTRA_TURNS))
    return chat.read_back(chat.windows(turns, budget=512))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), positive=1000, negative=3000))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), longest=2048, end_id=1)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), Workspace(spark, "op11"))


def op12_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, sales, items, vendors, clients = (table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients"))
    return target_encoding.sale_rates(lines, sales, items, vendors, clients, Workspace(spark, "op12"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Workspace(spark, "op13"), tokens=1024, end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_line_quality, op3_embedding_dedup, op4_substring_dedup, op5_minhash_dedup, op6_chat_windows, op7_toxicity, op8_token_counts, op9_bpe_codec, op10_packing, op11_prefix_trie, op12_target_encoding, op13_best_fit)}
