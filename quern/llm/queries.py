"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import sql
from quern.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.sharding import interleave

    out = interleave(_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.toxicity import classify

    out = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    import public_tokenizers
    from quern.llm.attribution import section_tokens

    return section_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.quality import classify

    out = classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.decontaminate import measure

    return measure(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)


def op7_arrow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quern.llm.arrow_ids import read_back, write_ids

    docs = _table(spark, sf_dir, "documents")
    folder, parts = write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_back(docs, folder, parts)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quern.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.rules import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm.licenses import scan, summarise

    return summarise(*scan(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_toxicity, op3_ngram_jaccard, op4_decontamination, op5_token_counts, op6_quality, op7_arrow_ids, op8_packing, op9_rules, op10_licenses)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sql.SHARDING, "op3_ngram_jaccard": sql.JACCARD, "op4_decontamination": sql.DECONTAMINATION}
